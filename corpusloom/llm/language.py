"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample text. A text is
encoded with each of them; the language whose dictionary gives the fewest bytes
is the prediction, and a text for which two are almost as good is rejected.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, table

#: The bound on what is learnt from: languages, those with most rows; rows of each; bytes of its dictionary, and of all dictionaries.
MOST_LANGUAGES = 1_000
SAMPLE_ROWS = 256
DICTIONARY_BYTES, ALL_BYTES = 32_768, 8 << 20
#: Excerpts that fill a dictionary, if texts are long; of short texts it holds more.
EXCERPTS = 16
#: A text is encoded in blocks of so many bytes, so that it can't become its own dictionary.
BLOCK_BYTES = 2_000
LEVEL = 5
#: A text, of any length, is rejected if the second-best size is within this share of the best; for texts of under 250 bytes that is a tie.
MARGIN = 0.004
UNKNOWN = "und"

_NOT_ASCII_LETTERS = re.compile(r"[^a-z]+")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")  # vowel signs and tone marks belong to their words


def _normal(text: str) -> str:
    """Lower-case words with single spaces: case, digits and symbols say nothing of the language."""
    low = text.lower()
    return " ".join(("", *(_NOT_ASCII_LETTERS if low.isascii() else _NOT_LETTERS).split(low), "")).replace("  ", " ")


@dataclass(frozen=True)
class LanguageModel:
    """The dictionaries by language, the language with the most training rows first."""

    dictionaries: dict[str, bytes]
    level: int = LEVEL
    block_bytes: int = BLOCK_BYTES
    margin: float = MARGIN
    _coders: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_coders": {}}  # coders can't travel

    def coders(self) -> dict[str, zstandard.ZstdCompressor]:
        if not self._coders:
            for lang, content in self.dictionaries.items():
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(self.level)
                self._coders[lang] = zstandard.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        return self._coders

    def sizes(self, text: str) -> dict[str, int]:
        """Bytes that the whole text takes, by language."""
        data = _normal(text).encode("utf-8", "surrogatepass")
        blocks = [data[i : i + self.block_bytes] for i in range(0, len(data), self.block_bytes)]
        return {lang: sum(len(coder.compress(block)) for block in blocks) for lang, coder in self.coders().items()}

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). On a tie the language with more training rows wins. A model that knows no language rejects only what has no letter."""
        if not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        if not self.dictionaries:
            return UNKNOWN, 0.0, False
        sizes = self.sizes(text)
        best = min(sizes, key=sizes.__getitem__)
        least = sizes[best]
        score = 1 / sum(2.0 ** (least - size) for size in sizes.values())  # a byte counts as one bit of evidence
        second = min((size for lang, size in sizes.items() if lang != best), default=None)
        return best, score, second is not None and second - least < self.margin * second


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES, most_languages: int = MOST_LANGUAGES) -> LanguageModel:
    """A model from labelled rows; rows without text or language are passed over.

    The bound: the most_languages languages with most rows, and about twice sample_rows different
    texts of each, drawn by the hash of the text, come to the driver as hashes; then an excerpt of
    dictionary_bytes / EXCERPTS characters of sample_rows of them, from a place that the hash tells.
    A dictionary holds as many of these as fill it: EXCERPTS of long texts. All dictionaries together
    have ALL_BYTES at most, so those of more than 256 languages are smaller.
    A language whose excerpts have fewer than 8 bytes of letters is not learnt, as zstandard takes no
    less. No labelled rows: a model that knows no language.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and length(text) > 0")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not counts:
        return LanguageModel({})
    spark = docs.sparkSession
    # Hashes are even: below this share of them, twice the rows wanted are expected.
    shares = F.broadcast(spark.createDataFrame([(r["lang"], min(1.0, 2 * sample_rows / r["count"])) for r in counts], "lang string, share double"))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    below = F.pmod(F.col("h"), F.lit(1 << 40)) < F.col("share") * (1 << 40)
    by_lang = defaultdict(list)
    for r in hashed.join(shares, "lang").where(below).select("lang", "h").distinct().collect():
        by_lang[r["lang"]].append(r["h"])
    drawn = F.broadcast(spark.createDataFrame([(lang, h) for lang, found in by_lang.items() for h in sorted(found)[:sample_rows]], "lang string, h long"))
    dictionary_bytes = min(dictionary_bytes, ALL_BYTES // len(counts))
    piece = max(1, dictionary_bytes // EXCERPTS)
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - piece, F.lit(0)) + 1) + 1
    excerpts = hashed.join(drawn, ["lang", "h"]).groupBy("lang", "h").agg(F.first(F.substr("text", start.cast("int"), F.lit(piece))).alias("text"))
    found = defaultdict(list)
    for r in excerpts.collect():
        found[r["lang"]].append((r["h"], r["text"]))
    dictionaries = {}
    for r in counts:
        content = b"".join(_normal(text).encode("utf-8", "surrogatepass") for _, text in sorted(found[r["lang"]]))
        if len(content) >= 8:
            dictionaries[r["lang"]] = content[:dictionary_bytes]
    return LanguageModel(dictionaries)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(every column of docs, lang_pred, lang_score, lang_rejected), without a shuffle.

    Whole texts are encoded. A text that is null, empty or without a letter is `und`,
    with score 0 and rejected; so is every other text, but not rejected, if the model knows no language. Only the text is looked at; null ids, repeated rows
    and other columns pass through (columns of docs by these three names are replaced).
    """
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name not in ("lang_pred", "lang_score", "lang_rejected")]
    at = [f.name for f in keep].index(text_col)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(at)]
            made = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    schema = type(docs.schema)(list(keep))
    for name, kind in (("lang_pred", "string"), ("lang_score", "double"), ("lang_rejected", "boolean")):
        schema = schema.add(name, kind)
    return docs.select(*(f"`{f.name}`" for f in keep)).mapInArrow(predicted, schema)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


QUERIES = {"op5_language_id": op5_language_id}
ORACLE_SQL: dict[str, str] = {}

"""Tokens, snippets, ids and JSON in text, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters at which str.split() of Python splits, for Java's regular expressions.
WS = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that carry no meaning in a question.
STOPWORDS = (
    "a an the in on at to for of with by is are was were be been has have had do does did but and or as if what where when who how why which"
).split()


def words(text: Column) -> Column:
    """Lower-case words between white space; punctuation and repeats stay."""
    return F.filter(F.split(F.lower(text), f"{WS}+"), lambda t: t != "")


def metric_tokens(text: Column) -> Column:
    """Distinct lower-case words without punctuation, stop-words and single letters; none for null."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.array_distinct(F.filter(F.split(bare, f"{WS}+"), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS)))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def snippet(text: Column, size: int = 300) -> Column:
    """The first characters on one line: cut first, then newlines to spaces."""
    return F.translate(F.left(text, F.lit(size)), "\n", " ")


def title(text: Column, count: int = 4) -> Column:
    """The first words as they are written."""
    return F.array_join(F.slice(F.filter(F.split(text, f"{WS}+"), lambda t: t != ""), 1, count), " ")


def company_code(name: Column) -> Column:
    """Letters and digits in upper case, ten at most; UNKNOWN if none are left."""
    return F.coalesce(F.nullif(F.left(F.upper(F.regexp_replace(name, r"[^\p{L}\p{N}]", "")), F.lit(10)), F.lit("")), F.lit("UNKNOWN"))


def token_estimate(*texts: Column) -> Column:
    """A quarter of the characters of all texts together, rounded down."""
    return F.floor(sum((F.length(F.coalesce(t, F.lit(""))) for t in texts), F.lit(0)) / 4).cast("int")


def json_safe(text: Column) -> Column:
    return F.regexp_replace(text, r'[\x00-\x1F"\\]', " ")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often the expression has it; filters may be pushed through it without multiplying it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def extract_json(text: Column) -> Column:
    """(json, error) as a struct: the JSON text in a reply, or why there is none.

    The first fenced block replaces the text; the earlier of `{` and `[` opens, the last closer of
    that kind ends. error is `none found`, `no closer`, `parse error` or null.
    """
    fence = r"(?s)```(?:json)?\s*(.*?)\s*```"

    def judged(body: Column, start: Column, end: Column) -> Column:
        # The parser stops behind the first value; as the only element of an array it must be all.
        valid = lambda found: F.coalesce(F.size(F.try_parse_json(F.concat(F.lit("["), found, F.lit("]"))).cast("array<variant>")) == 1, F.lit(False))
        error = lambda found: F.when(start == 0, "none found").when(end < start, "no closer").when(~valid(found), "parse error")
        whole = lambda found: _let(error(found), lambda e: F.struct(F.when(e.isNull(), found).alias("json"), e.alias("error")))
        return _let(F.substring(body, start, end - start + 1), whole)

    def closed(body: Column, start: Column, is_object: Column) -> Column:
        back = F.instr(F.reverse(body), F.when(is_object, F.lit("}")).otherwise(F.lit("]")))
        return _let(F.when(back > 0, F.length(body) - back + 1).otherwise(0), lambda end: judged(body, start, end))

    def opened(body: Column) -> Column:
        brace, bracket = F.instr(body, "{"), F.instr(body, "[")
        first = F.struct(F.when((brace > 0) & ((bracket == 0) | (brace < bracket)), brace).otherwise(bracket).alias("start"), ((brace > 0) & ((bracket == 0) | (brace < bracket))).alias("object"))
        return _let(first, lambda x: closed(body, x["start"], x["object"]))

    plain = stripped(F.coalesce(text, F.lit("")))
    return _let(plain, lambda p: _let(F.when(p.rlike(fence), F.regexp_extract(p, fence, 1)).otherwise(p), opened))


def with_json(df: DataFrame, column: str) -> DataFrame:
    """df with json and error of a column of replies; columns of these names are replaced."""
    names = [c for c in df.columns if c not in ("json", "error")]
    return df.select(*names, extract_json(F.col(column)).alias("_found")).select(*names, "_found.json", "_found.error")

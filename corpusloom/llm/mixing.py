"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words of its source up to and with it,
in a shuffled order, over its source's target. The documents, and their repeats after
them, are taken in order of that time until the total budget is reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import checkpointed, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = "mix"
#: Rows of a bucket, within which sums run in one task; with MOST_BUCKETS buckets they grow instead, as the buckets' totals of a source are summed in one task.
BUCKET_ROWS = 1_000
MOST_BUCKETS = 100_000


def targets_of(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, place, source_size, target) from (source, size): a row for each source.

    Sources in order of code points, null last, have the weights in turn. They share
    `share` of all words by weight; a target stops at `repeats` times its source's size
    and the rest share the excess, until none is above: all that don't stop have the
    same words for a unit of weight.
    """
    return sized.sparkSession.sql(
        f"""
        with totals as (select source, sum(size) as source_size from {{sized}} group by source),
        weighted as (
          select *, cast({repeats} * source_size as double) as most,
                 element_at(array({", ".join(map(str, weights))}), cast((place - 1) % {len(weights)} as int) + 1) as weight
          from (select *, row_number() over (order by source nulls last) as place from totals)
        ),
        filled as (
          select *, (cast({share} as double) * sum(source_size) over () - (sum(most) over (up_to) - most))
                    / (sum(weight) over () - (sum(weight) over (up_to) - weight)) as level
          from weighted
          window up_to as (order by most / weight, place rows unbounded preceding)
        ),
        levelled as (select min_by(level, (most / weight, place)) filter (where level <= most / weight) as level from filled)
        select source, place, source_size, least(most, coalesce((select level from levelled) * weight, most)) as target
        from weighted
        """,
        sized=sized,
    )


def _literal(value, kind: str) -> F.Column:
    """A value of a row as a literal of its own type."""
    return F.lit(value).cast(kind)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED, bucket_rows: int = BUCKET_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken, finish) of every row of docs, and the columns that it should carry.

    size is the number of words of the whole text (null: 0), copies how often the mix has the
    document, taken = copies * size, finish its first virtual finish time. The shuffled order is
    that of the md5 of seed and id, and of the text where the id is null, so reruns agree; rows with
    equal ids stand by size. Null sources are one source. Documents without words have
    finish times but take nothing; an empty table gives an empty result.

    No task sees a whole source: sums run within buckets of the shuffled order, whose totals are
    summed up for each source. The budget's end is found the same way, from totals of bins of the
    finish time and then the documents of one bin; one row of figures comes to the driver.
    """
    spark = docs.sparkSession
    h = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.md5(text_col), F.lit("")))), 1, 15), 16, 10).cast("long")
    sized = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"), *(F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry))))
    buckets = min(max(1, sized.count() // bucket_rows), MOST_BUCKETS)
    targets = targets_of(sized, weights, share, repeats)
    carried = "".join(f", {{table}}._carry{i}" for i in range(len(carry)))
    queued = checkpointed(
        spark.sql(
            f"""
            with placed as (
              select s.id, s.source, s.size, s.h, t.place, t.source_size, t.target, cast(s.h div {(1 << 60) // buckets + 1} as int) as bucket{carried.format(table='s')}
              from {{sized}} s join {{targets}} t on s.source <=> t.source
            ),
            bucket_sums as (
              select place, bucket, sum(total) over (partition by place order by bucket rows unbounded preceding) - total as before
              from (select place, bucket, sum(size) as total from placed group by place, bucket)
            )
            select p.id, p.source, p.size, p.h, p.place, p.source_size, p.target,
                   b.before + sum(p.size) over (partition by p.place, p.bucket order by p.h, p.id, p.size rows unbounded preceding) as upto{carried.format(table='p')}
            from placed p join bucket_sums b on p.place = b.place and p.bucket = b.bucket
            """,
            sized=sized,
            targets=targets,
        )
    )
    copies = spark.sql(
        f"""
        select id, size, h, place, copy, coalesce(try_divide(cast(copy * source_size + upto as double), target), 0D) as finish
        from {{queued}} lateral view explode(sequence(0, {repeats - 1})) as copy where size > 0
        """,
        queued=queued,
    )
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    bins = F.floor(F.col("finish") * buckets)
    filled = spark.sql(
        "select bin, upto - total as before, upto from (select *, sum(total) over (order by bin rows unbounded preceding) as upto from {totals})",
        totals=copies.groupBy(bins.alias("bin")).agg(F.sum("size").alias("total")),
    )
    last = filled.where(F.col("upto") > budget).orderBy("bin").first()  # None: all fits
    order = ["finish", "place", "h", "id", "size", "copy"]
    limit = None
    if last:
        reached = copies.where(bins == last["bin"]).withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        end = reached.where(F.col("upto") > F.lit(budget - last["before"])).orderBy(*order).select(*order).first()
        limit = F.struct(*(_literal(end[c], copies.schema[c].dataType.simpleString()).alias(c) for c in order))
    finish = lambda copy: F.coalesce(F.try_divide((copy * F.col("source_size") + F.col("upto")).cast("double"), F.col("target")), F.lit(0.0))
    each = F.array(*(F.struct(finish(F.lit(c)).alias("finish"), "place", "h", "id", "size", F.lit(c).alias("copy")) for c in range(repeats)))
    copies_of = F.when(F.col("size") > 0, F.size(F.filter(each, (lambda x: x < limit) if limit is not None else (lambda x: F.lit(True))))).otherwise(0)
    out = queued.select("id", "source", "size", "source_size", "target", copies_of.cast("bigint").alias("copies"), finish(F.lit(0)).alias("finish"), *(f"_carry{i}" for i in range(len(carry))))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "finish", *(F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5('mix' || coalesce(cast(doc_id as varchar), md5(text), '')), 1, 15) as bigint) as h
  from documents
), totals as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), weighted as (
  select *, cast(2 * source_size as double) as most, [3, 1, 2][cast((place - 1) % 3 as integer) + 1] as weight
  from (select *, row_number() over (order by source nulls last) as place from totals)
), filled as (
  select *, (cast(1.5 as double) * cast(sum(source_size) over () as double) - (sum(most) over up_to - most))
            / cast(sum(weight) over () - (sum(weight) over up_to - weight) as double) as level
  from weighted window up_to as (order by most / weight, place rows unbounded preceding)
), levelled as (
  select arg_min(level, place) as level from (select * from filled where level <= most / weight order by most / weight, place limit 1)
), targets as (
  select source, place, source_size, least(most, coalesce(levelled.level * weight, most)) as target from weighted, levelled
), queued as (
  select s.doc_id, s.size, s.h, t.place, t.source_size, t.target,
         sum(s.size) over (partition by t.place order by s.h, s.doc_id, s.size rows unbounded preceding) as upto
  from sized s join targets t on s.source is not distinct from t.source
), copies as (
  select *, case when target > 0 then cast(copy * source_size + upto as double) / target else 0 end as finish
  from queued, (values (0), (1)) as c(copy) where size > 0
), ordered as (
  select *, sum(size) over (order by finish, place, h, doc_id, size, copy rows unbounded preceding) as total from copies
), mixed as (
  select doc_id, h, size, place, sum(size) as taken from ordered where total <= (select sum(target) from targets) group by all
)
select q.doc_id, q.size, q.source_size, q.target, cast(coalesce(m.taken, 0) as bigint) as taken
from queued q left join mixed m on q.doc_id is not distinct from m.doc_id and q.h = m.h and q.size = m.size and q.place = m.place
"""

QUERIES = {"op8_source_mix": op8_source_mix}
ORACLE_SQL = {"op8_source_mix": ORACLE}

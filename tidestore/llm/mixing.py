"""Mixing sources to target weights under a time-varying curriculum.

Sizes are words. Each source has a weight; all sources together get ``share`` times all words, dealt by
weight, but none more than ``most`` times what it has (the excess is dealt again by weight).

Within a source the documents stand in the order of the MD5 of their ids and are read in passes, so
cumulative words give every take a place in its source's stream. A source's weight changes over
training time t in [0, 1] as ``w * (1 + slope * (2 t - 1))``; its integral is the source's cumulative
demand, and inverting that at a take's place gives the take's training position. Takes are
range-sorted by position.

Running sums never gather a source in one task: documents are bucketed by leading MD5 digits, buckets
are summed first, and the window of a task holds one bucket (some thousand rows at any input size).
Only one row a source goes to the driver.

Edge cases: null text counts 0 words; null source is a source of its own, last in order; a null id
orders as the empty string; an id that occurs twice is taken row by row; empty tables give empty
results; a source without words has target 0. Extra columns are ignored by the report and kept by
``mix_documents``, which adds none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestore.llm._frames import own_names, written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (5, 2, 1)  # of the sources in order of code points, repeating
    slopes: tuple[float, ...] = (0.5, 0.0, -0.5)  # of their weights over time, repeating; each between -1 and 1
    share: float = 1.5  # words of the mix, in words of all sources
    most: float = 2.0  # words of a source in the mix, in its own words
    bucket_rows: int = 4096


def water_fill(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Targets: proportional to weight, none above ``most`` times its size, the excess dealt again."""
    caps = [most * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    left, weight = share * sum(sizes), sum(weights)
    level = math.inf
    for i in order:
        if left / weight <= caps[i] / weights[i]:
            level = left / weight
            break
        left, weight = left - caps[i], weight - weights[i]
    return [c if level == math.inf else min(c, level * w) for c, w in zip(caps, weights, strict=True)]


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        _size().alias("size"),
        _order_key("doc_id").alias("key"),
    )


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _order_key(col: str) -> Column:
    return F.md5(F.coalesce(F.col(col).cast("string"), F.lit("")))


def _sources(sized: DataFrame, params: MixParams) -> tuple[DataFrame, int, bool]:
    """One row a source: source, source_no, source_size, target, slope; the rows of the largest source; whether to broadcast."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    weights = [float(params.weights[i % len(params.weights)]) for i in range(len(rows))]
    targets = water_fill([r["size"] for r in rows], weights, params.share, params.most)
    data = [(r["source"], i, r["size"], t, float(params.slopes[i % len(params.slopes)])) for i, (r, t) in enumerate(zip(rows, targets, strict=True))]
    schema = "source string, source_no int, source_size long, target double, slope double"
    return sized.sparkSession.createDataFrame(data, schema), max((r["n"] for r in rows), default=0), len(rows) <= 50_000


def _position(place: Column, target: Column, slope: Column) -> Column:
    """Training time at which the source's cumulative demand reaches ``place`` words."""
    y = F.when(target > 0, F.least(place / target, F.lit(1.0))).otherwise(F.lit(0.0))
    fall = 1 - slope
    root = fall + F.sqrt(fall * fall + 4 * slope * y)
    return F.when(root > 0, 2 * y / root).otherwise(F.lit(0.0))


def mix_plan(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, key, source, size, source_size, target, place, first_take, second_take, taken, first_position, second_position of every row.

    ``place`` is the words of the source before the row. ``first_take`` and ``second_take`` are the words taken in the
    first and in the second pass; the positions are the training times at which the source's integrated weight reaches
    their places, null for a pass that takes nothing. ``most`` may be 2 at most.
    """
    if params.most > 2:
        raise ValueError("two passes at most")
    sized = written(_sized(docs))
    sources, largest, few = _sources(sized, params)
    digits = max(0, math.ceil(math.log(max(1, largest / params.bucket_rows), 16)))
    rows = sized.join(F.broadcast(sources) if few else sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("bucket", F.substring("key", 1, digits))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source_no", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = rows.join(offsets, ["source_no", "bucket"]).withColumn("place", place)
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    part = lambda start: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), wanted - start))
    return (
        placed.withColumn("first_take", part(F.col("place")))
        .withColumn("second_take", part(F.col("source_size") + F.col("place")))
        .withColumn("taken", F.col("first_take") + F.col("second_take"))
        .withColumn("first_position", F.when(F.col("first_take") > 0, _position(F.col("place"), F.col("target"), F.col("slope"))))
        .withColumn("second_position", F.when(F.col("second_take") > 0, _position(F.col("source_size") + F.col("place"), F.col("target"), F.col("slope"))))
        .select("doc_id", "key", "source", "source_no", "size", "source_size", "target", "slope", "place", "first_take", "second_take", "taken", "first_position", "second_position")
    )


def _rank(ascending: Column, x: Column, most: int, field: str | None = None) -> Column:
    """How many of ``ascending`` (``most`` elements at most) are not above ``x``, by bisection."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, most.bit_length())))])
    at = lambda i: F.get(ascending, i)[field] if field else F.get(ascending, i)
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(at(n + step - 1) <= x, n + step).otherwise(n))


def _routes(plan: DataFrame) -> tuple[DataFrame, int]:
    """Where takes go, one row a source: source, source_no, source_size, target, slope, and by pass its cut and starts.

    Training time is cut into parts of about as many takes each. A pass's keys below its cut fall into
    runs, one a part: starts has the first key, the part and the words before it, of every run. Also
    returns how many starts a pass has at most.
    """
    of = ["source", "source_no", "source_size", "target", "slope"]
    half = lambda take: F.max((F.col(take) * 2 >= F.col("size")) & (F.col(take) > 0))
    ids = written(plan.groupBy(*of, "key").agg(F.min("place").alias("place"), F.max("place").alias("last"), F.array(half("first_take"), half("second_take")).alias("halves")))
    takes = ids.select(*of, "key", "place", "last", F.posexplode("halves").alias("take", "wanted"))
    cuts = takes.where("wanted").groupBy(F.col("source_no").alias("_no"), F.col("take").alias("_take")).agg(F.max("key").alias("cut"))
    takes = takes.join(F.broadcast(cuts), (F.col("source_no") == F.col("_no")) & (F.col("take") == F.col("_take")) & (F.col("key") <= F.col("cut"))).drop("_no", "_take")
    time = lambda place: _position(F.col(place) + F.col("take") * F.col("source_size"), F.col("target"), F.col("slope"))
    takes = written(takes.withColumn("position", time("place")).withColumn("until", time("last")))
    parts = min(4096, 2 * int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = takes.agg(F.percentile_approx("position", [i / parts for i in range(1, parts)], F.lit(20 * parts))).first()[0]
    bounds = sorted(set(found or []))
    part = lambda col: _rank(F.array(*map(F.lit, bounds)), F.col(col), len(bounds)) if bounds else F.lit(0)
    # rows that share an id stay in one part: no bound lies between their positions
    crossed = takes.where("place < last").select(part("position").alias("a"), part("until").alias("b")).where("a < b")
    inside = {r["i"] for r in crossed.select(F.explode(F.sequence("a", F.col("b") - 1)).alias("i")).distinct().collect()}
    bounds = [x for i, x in enumerate(bounds) if i not in inside]
    runs = takes.withColumn("part", part("position")).groupBy(*of, "take", "cut", "part").agg(F.min("key").alias("key"), F.min("place").alias("ahead"))
    passes = lambda i, value: F.when(F.col("take") == i, value)
    starts = [F.sort_array(F.collect_list(passes(i, F.struct("key", "part", "ahead")))).alias(f"starts{i}") for i in (0, 1)]
    return runs.groupBy(*of).agg(*[F.max(passes(i, F.col("cut"))).alias(f"cut{i}") for i in (0, 1)], *starts), len(bounds) + 1


def mix_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix itself: whole documents, once a take, with the columns of ``docs``, in order of position.

    The take at a pass's end, which the target cuts, counts if at least half of it is wanted; documents
    without words go with their neighbours. Texts are shuffled once, to parts of training time: the part
    of a take follows from its key by a small table (see ``_routes``) that also has the words ahead of
    the part, and running sums inside the part give every take its place and so its position.
    """
    plan = written(mix_plan(docs, params).select("source", "source_no", "key", "size", "source_size", "target", "slope", "place", "first_take", "second_take"))
    routes, most = _routes(plan)
    own, names = own_names(docs), docs.columns
    source, key, of, size, id_, hit, place = (own + x for x in ("source", "key", "of", "size", "id", "hit", "place"))
    routes = written(routes).select(F.col("source").alias(source), F.struct("source_no", "source_size", "target", "slope", "cut0", "cut1", "starts0", "starts1").alias(of))
    sized = docs.withColumn(key, _order_key("doc_id")).withColumn(id_, F.col("doc_id").cast("long")).withColumn(size, _size())
    routed = sized.join(F.broadcast(routes), F.col("source").cast("string").eqNullSafe(F.col(source)))

    def take(i: int) -> Column:
        starts = F.col(of)[f"starts{i}"]
        start = F.get(starts, _rank(starts, F.col(key), most, "key") - 1)
        fields = [F.col(of)[c].alias(c) for c in ("source_no", "source_size", "target", "slope")]
        return F.when(F.col(key) <= F.col(of)[f"cut{i}"], F.struct(start["part"].alias("part"), start["ahead"].alias("ahead"), F.lit(i).alias("take"), *fields))

    takes = routed.select(*(F.col(f"`{c}`") for c in names), key, id_, size, F.explode(F.array_compact(F.array(take(0), take(1)))).alias(hit))
    of_hit = lambda c: F.col(hit)[c]
    part, no, pass_ = (own + x for x in ("part", "no", "pass"))
    takes = takes.withColumn(part, of_hit("part")).withColumn(no, of_hit("source_no")).withColumn(pass_, of_hit("take"))
    before = Window.partitionBy(part, no, pass_).orderBy(key, id_, size).rowsBetween(Window.unboundedPreceding, -1)
    along = of_hit("take") * of_hit("source_size") + of_hit("ahead") + F.coalesce(F.sum(size).over(before), F.lit(0))
    placed = takes.repartitionByRange(F.col(part)).withColumn(place, along)
    left = F.least(F.col(size), F.floor(of_hit("target") + 0.5).cast("long") - F.col(place))
    kept = placed.where((F.col(size) == 0) | ((left > 0) & (left * 2 >= F.col(size))))
    position = own + "position"
    kept = kept.withColumn(position, _position(F.col(place), of_hit("target"), of_hit("slope")))
    return kept.sortWithinPartitions(part, position, key, pass_).select(*(F.col(f"`{c}`") for c in names))


def mix_report(docs: DataFrame) -> DataFrame:
    """Every row with the words taken of it and the training position of each take, range-sorted by the first position."""
    plan = mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "place", "first_position", "second_position")
    order = (F.col("first_position").asc_nulls_last(), "doc_id")
    return plan.repartitionByRange(*order).sortWithinPartitions(*order)


REPORT_SQL = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as key
  from documents),
src as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as no from sized group by source),
w as (
  select *, case no % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight, (2 * source_size)::double as cap from src),
f as (
  select *, 1.5::double * (sum(source_size) over ())::double
              - coalesce(sum(cap) over (order by cap / weight, no rows between unbounded preceding and 1 preceding), 0) as remaining,
         sum(weight) over (order by cap / weight, no rows between current row and unbounded following) as weight_left,
         row_number() over (order by cap / weight, no) as k
  from w),
level as (select arg_min(remaining / weight_left, k) as x from f where remaining / weight_left <= cap / weight),
tgt as (select f.*, coalesce(least(cap, x * weight), cap) as target from f, level),
placed as (
  select s.doc_id, s.size, t.source_size, t.target, case t.no % 3 when 0 then 0.5 when 1 then 0.0 else -0.5 end::double as slope,
         coalesce(sum(s.size) over (partition by t.no order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0)::bigint as place,
         floor(t.target + 0.5)::bigint as wanted
  from sized s join tgt t on s.source is not distinct from t.source),
takes as (
  select *, greatest(0, least(size, wanted - place)) as first, greatest(0, least(size, wanted - source_size - place)) as second,
         case when target > 0 then least(place / target, 1::double) else 0::double end as y1,
         case when target > 0 then least((source_size + place) / target, 1::double) else 0::double end as y2
  from placed)
select doc_id, size, source_size, target, (first + second)::bigint as taken, place,
       case when first > 0 then 2 * y1 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * y1)) end as first_position,
       case when second > 0 then 2 * y2 / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * y2)) end as second_position
from takes
"""

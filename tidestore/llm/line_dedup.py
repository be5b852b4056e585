"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line is removed if an earlier line, in the order of (doc_id, line number), is within the edit bound:
equal, or one inserted, deleted or replaced character apart. Lines are compared without white space at
their ends; blank lines are never removed and never compared. Earliest is judged on the input, not on
what is left.

1. One pass over the texts hashes every line (128 bits); equal lines are a class, known by its first place.
   The same pass hashes about half of the line from either end: of two lines one edit apart at least one
   such half is equal. Lines that share a half with no other distinct line have no neighbour.
2. The others, longer than ``whole_chars``, are cut into about the square root of their length of blocks. An
   edit lies in one block, so neighbours agree in all that lies before and behind it. Again only blocks
   that share both with another distinct line go on. Neither step drops a match; they keep a line from
   writing one variant for each of its characters.
3. A block that goes on emits all its variants with one character deleted, as hashed keys with what lies
   before and behind, and the block as it would be had the deletion happened already. Equal keys at an equal
   place are a replaced character; a whole block that equals a variant lacks one. Equal keys are joined with
   the earliest line of the key, not with one another, so a key with many lines gives as many links.
4. Links are verified by edit distance; the lines that an earlier one reaches go.

A line of n characters costs about n to the power 1.5 in hashing if it has possible neighbours, and n
otherwise; no row carries a copy of a line but the one that step 2 reads. Equal lines are counted before
they are shuffled, and each shuffle carries hashes, places and blocks, not lines. Small sides are broadcast
only after their bytes have been counted; beyond the bound the same join shuffles.

Edge cases: null texts stay null and empty ones empty; a document whose lines all go keeps its row with
an empty text. Rows without an id keep their lines and remove none. Rows that share an id are at the same
place: their lines count as earlier than those of larger ids only, and within the id by line number; what
goes is known by id and text, so a row loses none of its lines for another row's with that id. Texts may be
one line of any length. An empty table gives an empty result. Columns other than doc_id and text pass
unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidestore.llm._frames import own_names, written

BLANK = " \t\r\v\f"


@dataclass(frozen=True)
class LineDedupParams:
    whole_chars: int = 32  # lines up to this long are one block
    broadcast_bytes: int = 16 << 20


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where a lambda function uses it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _trimmed(raw: str) -> Column:
    """Without blanks at the ends; the slow trim runs only where there are any."""
    ends = [test(F.col(raw), F.lit(c)) for c in BLANK for test in (F.startswith, F.endswith)]
    any_ = ends[0]
    for e in ends[1:]:
        any_ = any_ | e
    return F.when(any_, F.btrim(raw, F.lit(BLANK))).otherwise(F.col(raw))


def _halves() -> Column:
    """Hashes of the ends that a line shares with any line one edit away.

    Of two such lines, the longer one of n characters, one end of ``n // 2`` characters is equal. Lengths are
    rounded down to 2 * (n // 4), so that only lines whose length is a multiple of four need the next
    lower one too, for the lines that are one shorter.
    """
    n = F.length("line")
    own = F.shiftleft(F.shiftright(n, 2), 1)
    keys = []
    for size, when in ((own, F.lit(True)), (own - 2, (n % 4) == 0)):
        keys += [F.when(when, F.xxhash64(size, F.lit("first"), F.left("line", size))), F.when(when & (size > 0), F.xxhash64(size, F.lit("last"), F.right("line", size)))]
    return F.array_compact(F.array(*keys))


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, of, line_no, h1, h2, halves of the lines that are compared; ``of`` is the hash of the row's text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("of")).where("doc_id is not null and text is not null")
    lines = texts.select("doc_id", "of", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    trimmed = lines.select("doc_id", "of", "line_no", _trimmed("raw").alias("line")).where("line != ''")
    return trimmed.select("doc_id", "of", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(41), "line").alias("h2"), _halves().alias("halves"))


def _small(df: DataFrame, bytes_: Column, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if it is small enough."""
    total = df.agg(F.sum(bytes_.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key several distinct lines (h1) have."""
    several = rows.groupBy(key).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select(key)
    return rows.join(several, key, "left_semi")


def _classes(places: DataFrame, docs: DataFrame, params: LineDedupParams) -> DataFrame:
    """place, h1, line of the distinct lines that share a half with another one, at their first places."""
    mates = written(_shared(places.select("h1", F.explode("halves").alias("half")), "half").select("h1").distinct())
    firsts = places.join(_small(mates, F.lit(8), params.broadcast_bytes), "h1", "left_semi").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "of")).alias("first"))
    wanted = firsts.groupBy(F.col("first.doc_id").alias("_id"), F.col("first.of").alias("of")).agg(F.collect_list(F.struct(F.col("first.line_no").alias("line_no"), "h1")).alias("wanted"))
    wanted = _small(written(wanted), F.size("wanted") * 12 + 32, params.broadcast_bytes)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("of"))
    found = texts.join(wanted, (F.col("doc_id") == F.col("_id")) & (texts["of"] == wanted["of"]))
    picked = _let(F.split("text", "\n"), lambda lines: F.transform("wanted", lambda x: F.struct(x["line_no"].alias("line_no"), x["h1"].alias("h1"), F.get(lines, x["line_no"]).alias("raw"))))
    rows = found.select("doc_id", F.explode(picked).alias("x")).select("doc_id", "x.line_no", "x.h1", F.btrim("x.raw", F.lit(BLANK)).alias("line"))
    return rows.select(F.struct("doc_id", "line_no", "h1").alias("place"), "h1", "line").dropDuplicates(["place"])


def _blocks(params: LineDedupParams) -> Column:
    """The blocks of a line of n characters, as one that another line of at most n characters equals but for an
    edit (role 0), and as one that a line of n + 1 characters equals but for a deletion (role 1).

    Borders follow from the longer line's length, so both sides of a match cut at the same places.
    """

    def role(shorter: int) -> Column:
        def cut(n: Column, count: Column) -> Column:
            border = lambda j: F.floor(j.cast("long") * n / count).cast("int")

            def block(j: Column) -> Column:
                a, b = border(j), border(j + 1)
                around = F.xxhash64(n, j, F.left("line", a), F.substring("line", b + 1 - shorter, n))
                return F.struct(F.lit(shorter).alias("shorter"), (count == 1).alias("alone"), a.alias("ahead"), around.alias("around"), F.substring("line", a + 1, b - a - shorter).alias("content"))

            return F.transform(F.sequence(F.lit(0), count - 1), block)

        def blocks(n: Column) -> Column:
            side = F.greatest(F.lit(params.whole_chars), F.floor(F.sqrt(n.cast("double"))).cast("int"))
            count = F.when(n <= params.whole_chars, F.lit(1)).otherwise(F.greatest(F.lit(2), F.ceil(n / side).cast("int")))
            return _let(count, lambda c: cut(n, c))

        return _let(F.length("line") + shorter, blocks)

    return F.concat(role(0), role(1))


def near_lines(places: DataFrame, docs: DataFrame, params: LineDedupParams = LineDedupParams()) -> DataFrame:
    """(doc_id, line_no, h1): first places and hashes of the distinct lines that are one edit from an earlier line."""
    classes = written(_classes(places, docs, params))
    before = lambda a, b: F.struct(a["doc_id"], a["line_no"]) < F.struct(b["doc_id"], b["line_no"])
    blocks = written(classes.select("place", "h1", F.explode(_blocks(params)).alias("x")).select("place", "h1", "x.*"))
    chosen = blocks.where("alone").unionByName(_shared(blocks.where("not alone"), "around").select(*blocks.columns))

    def variant(i: Column) -> Column:
        return F.struct((F.col("ahead") + i).alias("at"), F.xxhash64("around", F.concat(F.left("content", i - 1), F.substring("content", i + 1, F.length("content")))).alias("key"))

    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64("around", "content").alias("key")))
    emitted = F.when(F.col("shorter") == 1, whole).otherwise(F.transform(F.sequence(F.lit(1), F.length("content")), variant))
    rows = chosen.select("place", F.explode(emitted).alias("v")).select("place", "v.at", "v.key")
    # one shuffle and one sort serve both: a running first value needs no group in memory
    of_key = Window.partitionBy("key").orderBy("at", "place").rowsBetween(Window.unboundedPreceding, 0)
    of_place = Window.partitionBy("key", "at").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    known = rows.withColumn("whole", F.first(F.when(F.col("at") == 0, F.col("place"))).over(of_key)).withColumn("first", F.first("place").over(of_place))
    deleted = known.where("at > 0")
    own, first, all_ = F.col("place"), F.col("first"), F.col("whole")
    links = F.array(  # (one that lacks or has another character at ``at``, the line that has the character, whether it lacks it)
        F.when(before(first, own), F.struct(first.alias("other"), "place", "at", F.lit(0).alias("lacks"))),
        F.when(before(own, all_) | before(all_, own), F.struct(all_.alias("other"), "place", "at", F.lit(1).alias("lacks"))),
    )
    links = deleted.select(F.explode(F.array_compact(links)).alias("l")).select("l.*").groupBy("other", "place", "lacks").agg(F.min("at").alias("at"))

    text = classes.select(F.col("place").alias("_place"), F.col("line"))
    both = links.join(text.withColumnRenamed("line", "a"), F.col("other") == F.col("_place")).drop("_place")
    both = both.join(text.withColumnRenamed("line", "b"), F.col("place") == F.col("_place"))
    # the edit distance is one: all that lies before and behind the one edit is equal, and the lines are distinct
    ends = (F.left("a", F.col("at") - 1) == F.left("b", F.col("at") - 1)) & (F.substring("a", F.col("at") + 1 - F.col("lacks"), F.length("a")) == F.substring("b", F.col("at") + 1, F.length("b")))
    verified = both.where(ends).select(F.greatest("place", "other").alias("place"))
    return verified.select("place.doc_id", "place.line_no", "place.h1").distinct()


def removed_lines(docs: DataFrame, params: LineDedupParams = LineDedupParams()) -> DataFrame:
    """doc_id, of, removed: the numbers (from 0) of the lines that go, for rows (by id and hash of the text) that lose any."""
    places = written(_lines(docs))
    hashes = places.select("doc_id", "of", "line_no", "h1", "h2")
    first = hashes.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = hashes.join(first, ["h1", "h2"]).where(F.struct("doc_id", "line_no") > F.col("first")).select("doc_id", "of", "line_no")
    near = _small(written(near_lines(places, docs, params)), F.lit(20), params.broadcast_bytes)
    near = hashes.join(near, ["doc_id", "line_no", "h1"], "left_semi").select("doc_id", "of", "line_no")
    gone = repeated.unionByName(near).groupBy("doc_id", "of").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))
    return written(gone)


def dedup_lines(docs: DataFrame, params: LineDedupParams = LineDedupParams(), removed: str | None = None) -> DataFrame:
    """``docs`` with the lines that stay; ``removed`` names a column for the numbers of those that went."""
    own = own_names(docs)
    id_, of, numbers = own + "id", own + "of", own + "removed"
    gone = removed_lines(docs, params).select(F.col("doc_id").alias(id_), F.col("of").alias(of), F.col("removed").alias(numbers))
    gone = _small(gone, F.size(numbers) * 4 + 48, params.broadcast_bytes)
    joined = docs.join(gone, (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(of)), "left")

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(numbers))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    text = F.when(F.col(numbers).isNull() | F.col("text").isNull(), F.col("text")).otherwise(_let(F.split("text", "\n"), rest)).alias("text")
    columns = [text if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *([F.coalesce(numbers, F.array().cast("array<int>")).alias(removed)] if removed else []))


def line_dedup_report(docs: DataFrame) -> DataFrame:
    kept = dedup_lines(docs.select("doc_id", "text", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("lines")), removed="gone")
    return kept.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("lines")).cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


REPORT_SQL = """
with raw as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
l as (
  select doc_id, line_no, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) as line
  from (select doc_id, unnest(range(len(lines))) as line_no, unnest(lines) as raw from raw where doc_id is not null and text is not null)),
c as (select line, min(struct_pack(d := doc_id, n := line_no)) as first, length(line) as len from l where line != '' group by line),
halves as (
  select len as m, len // 2 as h, * from c
  union all select len - 1, (len - 1) // 2, * from c),
cand as (
  select a.line as x, b.line as y, a.first as xf, b.first as yf, a.len as xl, b.len as yl
  from halves a join halves b on a.m = b.m and left(a.line, a.h) = left(b.line, b.h) and a.len <= b.len and a.line != b.line and a.m = a.len
  union
  select a.line, b.line, a.first, b.first, a.len, b.len
  from halves a join halves b on a.m = b.m and right(a.line, a.m - a.h) = right(b.line, b.m - b.h) and a.len <= b.len and a.line != b.line and a.m = a.len),
link as (
  select greatest(xf, yf) as place from cand
  where len(list_filter(range(0, yl), lambda p : left(x, p) = left(y, p) and substr(x, case when xl = yl then p + 2 else p + 1 end) = substr(y, p + 2))) > 0),
gone as (
  select distinct l.doc_id, l.line_no from l join c using (line)
  where l.line != '' and (struct_pack(d := l.doc_id, n := l.line_no) > c.first
     or (struct_pack(d := l.doc_id, n := l.line_no) = c.first and c.first in (select place from link))))
select r.doc_id,
       case when r.text is null then 0 else len(r.lines) end::bigint as n_lines,
       coalesce(len(g.numbers), 0)::bigint as n_removed,
       sha256(case when r.text is null then '' when g.numbers is null then r.text
              else array_to_string(list_filter(r.lines, lambda x, i : not list_contains(g.numbers, i - 1)), chr(10)) end) as kept_sha256
from raw r left join (select doc_id, list(line_no) as numbers from gone group by doc_id) g on r.doc_id = g.doc_id
"""

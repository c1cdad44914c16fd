"""Exact n-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import kept, small_batches, written
from .textnp import cut_words, mixed, text_blocks

#: Fragments of the global order end before shingles of these document frequencies.
CUTS = (4, 16, 256)
#: Members of a shingle that meet in one task.
MEET = 1000
#: Sets of a component that are held against another block's in one row.
BLOCK = 128
SETS = "doc_id long, n long, lo long, hi long"


def _sets(width: int, keep: str, share: float = 1.0):
    """A function for mapInArrow: (doc_id, text) to the size of each text's shingle set, two hashes of it that come from independent hashes of its words, and some or all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = int(share * 2**63)
        for batch in batches:
            ids = batch.column("doc_id")
            for i, j, data, offsets in text_blocks(batch.column("text")):
                words = cut_words(data, offsets)
                (h, at), (other, _) = words.shingles(width), words.shingles(width, 1)
                n, lo, hi, parts, sizes = [], [], [], [], []
                for k in range(j - i):
                    u, where = np.unique(h[at[k] : at[k + 1]], return_index=True)
                    n.append(len(u))
                    lo.append(int(mixed(u, 11).sum(dtype=np.uint64)))
                    hi.append(int(mixed(other[at[k] : at[k + 1]][where], 12).sum(dtype=np.uint64)))
                    if keep:
                        u = (u >> np.uint64(1)).astype(np.int64) if share == 1 else (u[: np.searchsorted(u, np.uint64(2 * top))] >> np.uint64(1)).astype(np.int64)
                        parts.append(u)
                        sizes.append(len(u))
                out = [ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(np.array(lo, np.uint64).view(np.int64)), pa.array(np.array(hi, np.uint64).view(np.int64))]
                names = ["doc_id", "n", "lo", "hi"]
                if keep:
                    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat)))
                    names.append(keep)
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def set_of(text: Column, width: int) -> Column:
    """The size and hash (n, lo, hi) of a whole text's shingle set; all 0 without words."""

    @F.arrow_udf("n long, lo long, hi long")
    def identify(column: pa.Array) -> pa.Array:
        found = [x for b in _sets(width, "")([pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), column], ["doc_id", "text"])]) for x in [b.columns[1:]]]
        return pa.StructArray.from_arrays([pa.concat_arrays([x[k] for x in found]) if found else pa.array([], pa.int64()) for k in range(3)], ["n", "lo", "hi"])

    return identify(text.cast("string"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, every_link: bool = True) -> DataFrame:
    """Link texts whose sets of distinct word shingles have a Jaccard similarity of at least percent / 100.

    docs: doc_id long, text string; other columns are left alone. ASCII letters count in lower case and words end at
    ASCII white space. A text of fewer words than width is one shingle; a text without words has no shingle and no link.
    Returns, for each row of docs, doc_id, n_shingles and component_id, the smallest doc_id reachable by links (itself
    included), n_copies, the rows with an equal set, and n_links, the other sets, as classes of rows, that its own is linked to. A null text is empty. A row
    without doc_id is returned; its component is that of the rows with an equal set, or null, and it makes no links of its own. Repeated rows are equal sets. An
    empty table gives no rows.

    Rows with equal sets are one class. A link needs percent of either set to lie in other classes too, so classes with
    too many shingles of their own in one fragment (a share of the hash space) go at once. For the rest, the global
    order is (document frequency, hash). It is cut into fragments by frequency. Candidates meet on the rarest shingles
    they share: by size, the smaller set's index prefix and the larger one's probing prefix. Overlaps are counted in
    each fragment separately and summed per pair.

    Components come first. In a first round each prefix shingle's members meet only its purest member; members that this links to it need not meet one
    another. A second round meets whatever is not yet in its component. So no list of members is ever paired with itself as a whole, and no link that
    would join components is lost. Links lie within components: for n_links, each component is cut into blocks of like sets of about BLOCK, and each
    block meets each other that sizes allow, once: a row holds both, and no pair of texts is ever a row. Its work grows with the square of a
    component's classes, as the number of links does; without every_link it is not done, and there is no n_links.
    """
    rows, of = _labelled(docs, width, percent, every_link)
    number = ["n_links"] if every_link else []
    of = of.select("lo", "hi", F.col("n").alias("m"), "copies", "component_id", *number)
    back = (rows.lo == of.lo) & (rows.hi == of.hi) & (rows.n == of.m)
    return rows.join(of, back, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in number)
    )


def _labelled(docs: DataFrame, width: int, percent: int, every_link: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, lo, hi) of all rows, and the classes (lo, hi, n, doc_id, copies, component, component_id, n_links if asked) of those with words; doc_id is a class's least."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(docs.mapInArrow(_sets(width, ""), SETS), "sets")
    classes = rows.where("n > 0").groupBy("lo", "hi", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    spark = docs.sparkSession
    ordered = kept(spark, "ordered", lambda: _candidates(docs, classes, width, percent))
    parts = written(ordered.select("rep", "n", F.expr(_fragments()).alias("parts")), "fragments")
    labels = kept(spark, "labels", lambda: components(_links(ordered, parts, percent)))
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if every_link:
        named = named.join(kept(spark, "numbers", lambda: _numbers(parts, labels, percent)), "rep", "left")
    named = written(named, "classes")
    least = written(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "components")
    return rows, written(named.join(least, "component").drop("rep"), "classes")


def _fragments() -> str:
    """An array of a set's shingles in each fragment of the global order."""
    cuts = ", ".join(map(str, CUTS))
    return f"transform(sequence(0, {len(CUTS)}), f -> transform(filter(shingles, s -> s.df >= get(array(0, {cuts}), f) AND s.df < get(array({cuts}, 9223372036854775807L), f)), s -> s.h))"


def _numbers(parts: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(rep, n_links): how many sets each is linked to, by blocks of its component."""
    ratio = math.log(max(100 / percent, 1.001))
    level = F.floor(F.log("n") / ratio + 1e-9)  # linked sets are of one level or of neighbouring ones
    members = parts.join(labels.withColumnRenamed("node", "rep"), "rep").withColumn("level", level)
    sizes = members.groupBy("component", "level").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / (BLOCK * 4096))).alias("salts"))
    salted = members.join(written(sizes, "sizes"), ["component", "level"]).withColumn("salt", F.pmod(F.xxhash64("rep"), "salts"))
    blocks = salted.groupBy("component", "level", "salt").agg(F.collect_list(F.struct("rep", "n", "parts")).alias("m"))
    blocks = written(
        blocks.select(
            "component", "level", "salt", F.transform("m", lambda m: m.rep).alias("reps"), F.transform("m", lambda m: m.n).alias("ns"),
            F.transform("m", lambda m: m.parts).alias("parts")
        ),
        "blocks"
    )
    x = blocks.select(
        "component", F.col("level").alias("x_level"), F.col("salt").alias("x_salt"), *(F.col(c).alias(f"x_{c}") for c in ("reps", "ns", "parts")),
        F.explode(F.array("level", F.col("level") + 1)).alias("level")
    )
    y = blocks.select("component", "level", "salt", *(F.col(c).alias(f"y_{c}") for c in ("reps", "ns", "parts")))
    met = x.join(y, ["component", "level"]).where("level > x_level OR salt >= x_salt")
    met = met.select(
        (F.col("level") == F.col("x_level")).alias("same"), (F.col("salt") == F.col("x_salt")).alias("own"),
        *(f"{s}_{c}" for s in "xy" for c in ("reps", "ns", "parts"))
    )

    def sparse(cell: pa.ListScalar) -> list[tuple[np.ndarray, np.ndarray]]:
        """(shingles, members) of each fragment."""
        lists = cell.values.flatten()
        ends, flat, k = lists.offsets.to_numpy(), lists.values.to_numpy(), len(CUTS) + 1
        members = len(lists) // k
        return [(np.concatenate([flat[ends[m * k + f] : ends[m * k + f + 1]] for m in range(members)]), np.repeat(np.arange(members), np.diff(ends)[f::k])) for f in range(k)]

    def overlaps(a: tuple, b: tuple, n: int, m: int) -> np.ndarray:
        """How many shingles of a fragment each two members share: products of 0/1 matrices of the shingles found on both sides."""
        common, out = np.intersect1d(a[0], b[0]), np.zeros((n, m), np.float32)
        for at in range(0, len(common), 8192):
            some, sides = common[at : at + 8192], []
            for (h, of), size in ((a, n), (b, m)):
                place = np.minimum(np.searchsorted(some, h), len(some) - 1)
                hit = some[place] == h
                side = np.zeros((size, len(some)), np.float32)
                side[of[hit], place[hit]] = 1
                sides.append(side)
            out += sides[0] @ sides[1].T
        return out.astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for r in range(batch.num_rows):
                cell = {c: batch.column(c)[r] for c in batch.schema.names}
                own = cell["same"].as_py() and cell["own"].as_py()
                reps, ns = ({s: cell[f"{s}_{c}"].values.to_numpy() for s in "xy"} for c in ("reps", "ns"))
                if own and len(reps["x"]) < 2:
                    continue
                both = sum(overlaps(a, b, len(reps["x"]), len(reps["y"])) for a, b in zip(sparse(cell["x_parts"]), sparse(cell["y_parts"])))
                linked = 100 * both >= percent * (ns["x"][:, None] + ns["y"] - both)
                if own:
                    np.fill_diagonal(linked, False)
                found.append((reps["x"], linked.sum(axis=1)))
                if not own:
                    found.append((reps["y"], linked.sum(axis=0)))
            both_columns = [np.concatenate(c) if found else np.zeros(0, np.int64) for c in (list(zip(*found)) or ((), ()))]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in both_columns], ["rep", "links"])

    return met.mapInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("n_links"))


def _candidates(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, n, own, shingles) of the classes that may have links: shingles in the global order, own being the number of shingles found in no other class."""
    share = min(1.0, 1.35 * (100 - percent) / 100)
    some = docs.mapInArrow(_sets(width, "part", share), f"{SETS}, part array<long>").where("n > 0")
    lone = some.select("lo", F.explode("part").alias("h")).groupBy("h").agg(F.min("lo").alias("lo"), F.max("lo").alias("other")).where("lo = other").groupBy("lo").agg(F.count("*").alias("own"))
    left = classes.where("doc_id IS NOT NULL").join(lone, "lo", "left").where(f"100 * (n - coalesce(own, 0)) >= {percent} * n")
    left = written(left.select("doc_id", "rep", F.col("lo").alias("rep_lo"), F.col("hi").alias("rep_hi")), "left")
    texts = docs.join(left.select("doc_id").distinct().hint("shuffle_hash"), "doc_id").select("doc_id", "text")
    full = texts.mapInArrow(_sets(width, "part"), f"{SETS}, part array<long>").join(left, "doc_id").where("lo = rep_lo AND hi = rep_hi")
    full = written(full.dropDuplicates(["rep"]).select("rep", "n", "part"), "shingles")
    one = full.select("rep", "n", F.explode("part").alias("h"))
    shared = written(one.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    ordered = one.join(shared, "h").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shingles"))
    return ordered.where(f"100 * size(shingles) >= {percent} * n").select("rep", "n", (F.col("n") - F.size("shingles")).alias("own"), "shingles")


def _links(classes: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(a, b), once each: links that give the same components as all links."""
    p = percent
    parts = written(parts.select("rep", F.posexplode("parts").alias("fragment", "part")).where("size(part) > 0"), "fragments")
    probe = f"n - (({p} * n + 99) div 100) + 1"
    index = f"n - (({2 * p} * n + {99 + p}) div {100 + p}) + 1"
    places = classes.select(
        "rep", "n", "own",
        F.expr(f"transform(slice(shingles, 1, cast(greatest(0, {probe} - own) as int)), (s, i) -> struct(s.h AS h, own + i AS pos, own + i < {index} AS early))").alias("s")
    )
    places = written(places.select("rep", "n", "own", F.inline("s")), "postings")

    def may(x: str, y: str) -> str:
        """x is the smaller of the two and meets y at an early place of x; neither length nor place rules the pair out."""
        return (
            f"(struct({x}n, {x}rep) < struct({y}n, {y}rep) AND {x}early AND 100 * {x}n >= {p} * {y}n"
            f" AND least({x}n - {x}pos, {y}n - {y}pos) * {100 + p} >= {p} * ({x}n + {y}n))"
        )

    def linked(met: DataFrame) -> DataFrame:
        """Of the pairs of columns x_ and y_, overlaps counted by fragment, then summed per pair; the one of smaller rep is a."""
        low = F.col("x_rep") < F.col("y_rep")
        pairs = met.select(
            F.least("x_rep", "y_rep").alias("a"), F.when(low, F.col("x_n")).otherwise(F.col("y_n")).alias("na"),
            F.greatest("x_rep", "y_rep").alias("b"), F.when(low, F.col("y_n")).otherwise(F.col("x_n")).alias("nb")
        )
        pairs = written(pairs.distinct(), "pairs")
        one = pairs.join(parts.withColumnsRenamed({"rep": "b", "part": "part_b"}), "b")
        two = one.join(parts.withColumnsRenamed({"rep": "a", "part": "part_a"}), ["a", "fragment"])
        sums = two.select("a", "b", "na", "nb", F.size(F.array_intersect("part_a", "part_b")).alias("both")).groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
        return written(sums.where(f"100 * both >= {p} * (na + nb - both)").select("a", "b"), "links")

    def side(df: DataFrame, name: str, *more: str) -> DataFrame:
        return df.select("h", *more, *(F.col(c).alias(f"{name}_{c}") for c in ("rep", "n", "pos", "early", "label")))

    pivots = places.where("early").groupBy("h").agg(F.min(F.struct("own", "n", "rep", "pos")).alias("x"))
    pivots = written(pivots.select("h", *(F.col(f"x.{c}").alias(f"y_{c}") for c in ("n", "rep", "pos"))), "pivots")
    star = side(places.withColumn("label", F.col("rep")), "x").join(pivots.withColumn("y_early", F.lit(True)), "h").where("x_rep != y_rep")
    first = linked(star.where(f"{may('x_', 'y_')} OR {may('y_', 'x_')}"))
    label = components(first)
    named = written(places.join(label.withColumnsRenamed({"node": "rep", "component": "label"}), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "postings")
    pivot = pivots.join(label.withColumnsRenamed({"node": "y_rep", "component": "p_label"}), "y_rep", "left").select("h", F.coalesce("p_label", "y_rep").alias("p_label"))
    apart = written(named.join(written(pivot, "pivots"), "h").where("label != p_label").drop("p_label"), "apart")
    # a hot shingle's members meet in parts of MEET
    salts = written(apart.groupBy("h").agg(F.expr(f"(count(*) + {MEET - 1}) div {MEET}").alias("salts")), "salts")
    x = side(apart.join(salts, "h").withColumn("salt", F.pmod(F.xxhash64("rep"), "salts")), "x", "salt")
    y = side(named.join(salts, "h").withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)"))), "y", "salt")
    rest = x.join(y, ["h", "salt"]).where("x_label != y_label").where(f"{may('x_', 'y_')} OR {may('y_', 'x_')}")
    return first.union(linked(rest))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs with one left of each component of jaccard_components(), that of least doc_id, with all their columns, whatever their names.

    Of rows with one doc_id and equal sets, one stays; rows with one doc_id and different texts are documents of their own, and go only for a link. Rows without words
    stay. A row without doc_id goes if its set is that of another row. An empty table gives no rows.
    """
    _, classes = _labelled(docs, width, percent, every_link=False)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "lo", "hi", "n"))
    kept = written(classes.groupBy("component").agg(best.alias("b")).select(F.coalesce("b.doc_id", F.lit(-1).cast("long")).alias("id"), "b.no_id", "b.lo", "b.hi", "b.n"), "kept")
    bare = F.length(F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(" \t\n\v\f\r"))) == 0
    named = docs.where(~bare).select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), set_of(F.col("text"), width).alias("s"))
    keys = ["id", "no_id", "lo", "hi", "n"]
    named = named.select("row", F.coalesce("id", F.lit(-1).cast("long")).alias("id"), F.col("id").isNull().alias("no_id"), "s.*")
    left = named.join(kept, keys, "left_semi").dropDuplicates(keys)
    return left.select("row.*").unionByName(docs.where(bare))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join over all documents, with every link counted: four-word shingles, similarity 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS g FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS rep, count(*) AS n_copies, len(g) AS n, g FROM s WHERE len(g) > 0 GROUP BY g),
u AS MATERIALIZED (SELECT rep, n, unnest(g) AS h FROM c),
l AS MATERIALIZED (
  SELECT x.rep AS a, y.rep AS b FROM u x JOIN u y ON x.h = y.h AND x.rep <> y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r(rep, seen) AS (SELECT rep, rep FROM c UNION SELECT r.rep, l.b FROM r JOIN l ON l.a = r.seen),
k AS (SELECT rep, min(seen) AS component_id FROM r GROUP BY rep),
d AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id, coalesce(c.n_copies, 1)::BIGINT AS n_copies, coalesce(d.n_links, 0)::BIGINT AS n_links
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN k ON k.rep = c.rep LEFT JOIN d ON d.a = c.rep"""

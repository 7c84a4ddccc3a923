"""N-gram Jaccard join by a token-group matrix.

A document's tokens are the hashes of its distinct five-word shingles. Documents of one
set are one class, and similar classes are partitioned into groups of bounded size by
their smallest tokens. Two sets reach the threshold only if the first ``n - ceil(t n) + 1`` tokens of each,
in any order common to all, share one; frequent tokens are last in the order. The matrix stores which of these tokens stand in
which group; it names the groups that a query may have to do with. There, the union of all tokens of the group's members
is made once, and the query's overlap with the union is counted: no member shares more with it. Only groups where this bound
reaches the threshold's share of the query are opened, only for members whose sizes the bound allows, and these
are compared with the query exactly.

Copies by the thousand don't make pairs by the million: a first round asks, for each
token, only one pivot group, that of its most central class, and each class's own group. What these links connect needs no
more. The second round asks the remaining groups, for classes that are in
another component than a member and in a band of like sizes. Of crowded classes, which would meet many more others than they have
tokens, all tokens are counted: one that a single crowded class has can't be shared among
them, so what is left of a set bounds the overlaps and thereby the sizes of crowded sets
that it can link with. Many copies just below the threshold are told apart by this, not
pair by pair. So every component is the true one.

Tokens are 64-bit hashes; sets are compared on 40 of those bits, which are all distinct within
a pair but for about one pair of tokens in 10^6 documents.

Defined results: null, empty and blank texts have no shingles and are their own
component; a text of fewer than five words has one shingle; rows with equal texts are linked; each row is a document,
also where ids are null, repeat or are no numbers: a component's id is its smallest that isn't null; texts of any length are taken
whole; an empty table gives an empty table; columns other than the id and the text are not
carried along, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, by_row, documents, map_batches, settle, spread_join
from .components import components

SHINGLE, PERCENT = 5, 80
#: Members of a group, and queries that meet it in one task, at most about.
GROUP, QUERIES = 64, 1000
#: Tokens of more postings than this (by hashes alone, which post a fifth of all) are frequent; only so many are told to all tasks (8 bytes each):
#: if there are more, those above the least number of postings that leaves no more.
FREQUENT, TOLD = 2, 1 << 20
#: A class is crowded if its tokens are held so many times as often as it has tokens; any value gives the same result.
CROWDED = 4
BYTES = 5
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    import xxhash

    words = text.encode().lower().split() if text else []  # of bytes: A-Z, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * _MULTIPLY + h[k : len(h) - n + 1 + k]
        return np.unique(_mix(out))


def set_print(tokens: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def group_key(tokens: np.ndarray) -> int:
    """Alike for similar sets: the smallest tokens of two orders."""
    return int((tokens[0] ^ _mix(tokens * _MULTIPLY).min()).astype(np.int64)) if len(tokens) else 0


def prefix(tokens: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The tokens of which two qualifying sets share one; frequent tokens are last in the order."""
    n = len(tokens)
    most = n + (-percent * n // 100) + 1
    if not len(frequent):
        return tokens[:most]
    at = np.searchsorted(frequent, tokens)
    late = frequent[np.minimum(at, len(frequent) - 1)] == tokens
    rare = tokens[~late][:most]
    return rare if len(rare) == most else np.concatenate([rare, tokens[late][: most - len(rare)]])


def _map(df: DataFrame, make, schema: str, id_col: str, text_col: str) -> DataFrame:  # type: ignore[no-untyped-def]
    """``make`` gets (id, text) pairs of a batch and the task's memory, and returns columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                b = whole.slice(k, 500)
                yield pa.RecordBatch.from_arrays(make(b, memory), [c.split()[0] for c in schema.split(", ")])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)


def profiles(df: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Size, print and group key of each row's set; of each distinct set in a task also its prefix by hashes alone."""

    def make(b: pa.RecordBatch, seen: dict) -> list[pa.Array]:
        sets = [shingle_set(t) for t in b.column(1).to_pylist()]
        prints = [set_print(s) for s in sets]
        first = []
        for s, p in zip(sets, prints):
            first.append(None if p in seen else prefix(s, np.zeros(0, np.uint64), percent).view(np.int64))
            seen[p] = None
        return [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()), pa.array(map(group_key, sets), pa.int64()), pa.array(first, pa.list_(pa.int64()))]

    return _map(df, make, f"id {df.schema[id_col].dataType.simpleString()}, n long, print long, gkey long, tokens array<long>", id_col, text_col)


def postings(df: DataFrame, frequent: np.ndarray, percent: int, id_col: str, text_col: str) -> DataFrame:
    """token and print of each distinct set in a task."""

    def make(b: pa.RecordBatch, seen: dict) -> list[pa.Array]:
        tokens, prints = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for t in b.column(1).to_pylist():
            s = shingle_set(t)
            if len(s) and (p := set_print(s)) not in seen:
                seen[p] = None
                tokens.append(prefix(s, frequent, percent))
                prints.append(np.full(len(tokens[-1]), p, np.int64))
        return [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(prints))]

    return _map(df, make, "token long, print long", id_col, text_col)


def packed_sets(df: DataFrame) -> DataFrame:
    """print, n and the packed tokens; ``df``: id (the print) and text."""

    def make(b: pa.RecordBatch, _: dict) -> list[pa.Array]:
        sets = [shingle_set(t) for t in b.column(1).to_pylist()]
        return [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes() for s in sets], pa.binary())]

    return _map(df, make, "print long, n long, tokens binary", "print", "text")


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, BYTES)
    return np.sort(out.view(np.uint64).ravel())


def overlap(small: np.ndarray, large: np.ndarray) -> int:
    return int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(large) else 0


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = overlap(a, b) if len(a) <= len(b) else overlap(b, a)
    return 100 * both >= percent * (len(a) + len(b) - both)


def largest(query: np.ndarray, union: np.ndarray, percent: int) -> int:
    """The size of the largest member of a group that the query can link with, by its overlap with their union; 0: the group stays shut."""
    bound = overlap(query, union)
    return (100 + percent) * bound // percent - len(query) if 100 * bound >= percent * len(query) else 0


def frequent_tokens(counts: DataFrame, least: int = FREQUENT, most: int = TOLD) -> np.ndarray:
    """Sorted tokens of more than ``least`` postings, at most ``most``. ``counts``: token and c.

    The numbers of tokens per step of c, a few hundred rows, tell where to cut; only tokens above the cut reach the driver.
    """
    some = counts.where(F.col("c") > least).withColumn("step", F.floor(F.log2("c") * 4).cast("int"))
    cut, total = None, 0
    for step, n in sorted(map(tuple, some.groupBy("step").count().collect()), reverse=True):
        total += n
        if total > most:
            break
        cut = step
    if cut is None:
        return np.zeros(0, np.uint64)
    return np.sort(some.where(F.col("step") >= cut).select("token").toArrow().column(0).to_numpy().view(np.uint64))


def reach(classes: DataFrame, members: DataFrame, docs: DataFrame, stash: Stash, percent: int) -> DataFrame:
    """print, hi: the largest set that each class can link with, among ``classes`` (print).

    Of ``n`` tokens let others have ``v`` too; no overlap is above ``v``, so a partner has at most
    ``v (100 + percent) / percent - n`` tokens.
    """

    def make(b: pa.RecordBatch, _: dict) -> list[pa.Array]:
        sets = [shingle_set(t) for t in b.column(1).to_pylist()]
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        return [pa.array(flat), pa.array(np.repeat(b.column(0).to_numpy(), [len(s) for s in sets]))]

    reps = members.join(classes, "print", "left_semi").select("print", F.col("rep").alias("id"))
    tokens = stash.put(_map(docs.join(reps, "id").select("print", "text"), make, "token long, print long", "print", "text"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    v = tokens.join(shared, "token", "left_semi").groupBy("print").agg(F.count(F.lit(1)).alias("v"))
    hi = F.floor(F.col("v") * (100 + percent) / percent) - F.col("n")
    out = stash.put(members.select("print", "n").join(v, "print").select("print", hi.alias("hi")))
    stash.drop(tokens)
    settle(docs.sparkSession)
    return out


def verify(asked: DataFrame, members: DataFrame, docs: DataFrame, stash: Stash, percent: int, report: list | None = None) -> DataFrame:
    """Links (a, b) of the queries and members of groups that the bound opens, as few as connect the same.

    ``asked``: query, gid. ``members``: print, n, gid, rep. A group's members, and with them their union, meet its queries in
    as many tasks as the queries need. ``report`` gets the numbers of pairs of a query and a group that were asked, and opened.
    """
    load = asked.groupBy("gid").agg(F.count(F.lit(1)).alias("q"))
    load = stash.put(load.select("gid", F.ceil(F.col("q") / QUERIES).cast("int").alias("parts")))
    inside = members.join(load, "gid")
    needed = inside.select("print").union(asked.select(F.col("query").alias("print"))).distinct()
    reps = members.join(needed, "print", "left_semi").select("print", F.col("rep").alias("id"))
    sets = stash.put(packed_sets(docs.join(reps, "id").select("print", "text")))
    settle(docs.sparkSession)
    rows = inside.select("gid", F.lit(0).alias("role"), "print", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    queries = asked.join(load, "gid").select("gid", F.lit(1).alias("role"), F.col("query").alias("print"), F.pmod(F.xxhash64("query"), "parts").cast("int").alias("part"))
    full = rows.unionByName(queries).join(sets, "print")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    met = full.repartition(n, "gid", "part").sortWithinPartitions("gid", "part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, group, union, roots = None, [], None, {}

        def root(x: int) -> int:
            while roots.setdefault(x, x) != x:
                roots[x] = roots[roots[x]]
                x = roots[x]
            return x

        for b in batches:
            found, tried, opened = [], 0, 0
            for gid, part, role, p, raw in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (gid, part) != at:
                    at, group, union, roots = (gid, part), [], None, {}
                s = unpack(raw)
                if role == 0:
                    group.append((p, s))
                    continue
                if union is None:
                    union = group[0][1] if len(group) == 1 else np.unique(np.concatenate([t for _, t in group]))
                most = largest(s, union, percent)
                tried, opened = tried + 1, opened + (most > 0)
                for other, t in group if most else ():
                    if len(t) <= most and other != p and root(other) != root(p) and similar(s, t, percent):
                        roots[root(p)] = root(other)
                        found.append((p, other))
            rows = [(a, b, None, None) for a, b in found] + [(None, None, tried, opened)]  # the last row tells of the batch
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "asked", "opened"])

    links = stash.put(map_batches(met.select("gid", "part", "role", "print", "tokens"), run, "a long, b long, asked long, opened long"))
    stash.drop(sets, load)
    settle(docs.sparkSession)
    if report is not None:
        report.append(tuple(x or 0 for x in links.agg(F.sum("asked"), F.sum("opened")).first()))
    return links.where("a IS NOT NULL").select("a", "b")


def join(spark: SparkSession, df: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", report: list | None = None) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id``: the smallest id that links reach.

    ``report`` gets, per round, how many pairs of a query and a group were asked, and how many of them the bound opened.
    """
    stash = Stash(spark, "shingles")
    keyed, same = by_row(df.select(id_col, text_col), id_col, text_col, stash)
    docs = keyed.select(F.col("row").alias("id"), "text")
    wide = stash.put(profiles(docs, percent, "id", "text"))
    counts = stash.put(wide.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > FREQUENT))
    frequent = frequent_tokens(counts, FREQUENT, TOLD)
    stash.drop(counts)
    own = stash.put(wide.drop("tokens"))
    stash.drop(wide)
    settle(spark)
    classes = stash.put(own.where("n > 0").groupBy("print", "n").agg(F.min("id").alias("rep"), F.first("gkey").alias("gkey")))
    crowd = stash.put(classes.groupBy("gkey").agg(F.count(F.lit(1)).alias("c")))
    parts = F.ceil(F.col("c") / GROUP)
    members = stash.put(spread_join(classes, crowd, ["gkey"], classes.count()).select("print", "n", "rep", F.xxhash64("gkey", F.pmod(F.xxhash64("print"), parts)).alias("gid"), "c"))
    stash.drop(classes, crowd)
    raw = stash.put(postings(docs, frequent, percent, "id", "text"))
    # A token that is posted once links nothing; copies in several tasks post theirs again, which does no harm.
    shared = raw.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    narrow = stash.put(raw.join(shared, "token"))
    stash.drop(raw)
    settle(spark)
    # A class is central if many others post its tokens: the text that others were made from is, its copies less so.
    central = narrow.groupBy("print").agg(F.sum("c").alias("central"))
    placed = members.select("print", "n", "gid").join(central, "print")
    matrix = stash.put(narrow.join(placed, "print").select("token", "print", "n", "gid", "central"))
    stash.drop(narrow)
    settle(spark)

    sizes = members.groupBy("gid").agg(F.min("n").alias("least"), F.max("n").alias("most"))

    def qualifying(pairs: DataFrame) -> DataFrame:
        fits = (F.col("n") * percent <= F.col("most") * 100) & (F.col("least") * percent <= F.col("n") * 100)
        return pairs.join(sizes, "gid").where(fits).select("query", "gid")

    pivot = matrix.groupBy("token").agg(F.max_by("gid", F.struct("central", "gid")).alias("pivot"), F.min("gid").alias("x"), F.max("gid").alias("y")).where("x <> y").select("token", "pivot")
    near = matrix.join(pivot, "token").where("gid <> pivot").select(F.col("print").alias("query"), "n", F.col("pivot").alias("gid")).distinct()
    at_home = members.where("c > 1").select(F.col("print").alias("query"), "gid")
    first = stash.put(qualifying(near).unionByName(at_home))
    links = verify(first, members, docs, stash, percent, report)
    comp = stash.put(components(links, stash))

    # Round two: tokens that still join components. For each pair, classes of the smaller side ask.
    # Crowded classes meet only where each side's size is within the other's reach.
    label = matrix.join(comp, matrix["print"] == comp["node"], "left").select("token", "print", "n", "gid", F.coalesce("comp", "print").alias("comp"))
    open_ = label.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("c")).where("x <> y").select("token", "c")
    every = stash.put(label.join(open_, "token"))
    crowded = every.groupBy("print", "n").agg(F.sum("c").alias("c")).where(F.col("c") > F.col("n") * CROWDED).select("print")
    can = reach(crowded, members, docs, stash, percent)
    label = every.drop("c").join(can, "print", "left")
    weight = label.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("w"))
    top = weight.groupBy("token").agg(F.max(F.struct("w", "comp")).alias("top"))
    side = label.join(weight, ["token", "comp"])
    asks = side.join(top, "token").where(F.struct("w", "comp") < F.col("top")).select("token", F.col("print").alias("query"), "n", "hi", F.struct("w", "comp").alias("mine"))
    # Sizes that can link lie in the same band or in neighbouring ones.
    band = F.floor(F.log(F.col("n")) / max(1.001 * math.log(100 / percent), 1e-6)).cast("int")
    holds = side.groupBy("token", "gid", band.alias("band"), F.struct("w", "comp").alias("theirs"), F.isnull("hi").alias("free")).agg(F.min("n").alias("from_n"), F.max("hi").alias("to_n"))
    holds = holds.withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))))
    pairs = asks.withColumn("band", band).join(holds, ["token", "band"]).where("mine < theirs AND (free OR hi IS NULL OR from_n <= hi AND n <= to_n)").select("query", "n", "gid").distinct()
    second = stash.put(qualifying(pairs).join(first, ["query", "gid"], "left_anti"))
    more = verify(second, members, docs, stash, percent, report)
    whole = components(links.union(more), stash)

    named = members.join(whole, members["print"] == whole["node"], "left").select("print", "n", "rep", F.coalesce("comp", "print").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = named.join(least, "comp").select("print", "n", "component_id")
    out = own.join(by_class, ["print", "n"], "left").select(F.col("id").alias("row"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("first"))
    if same:
        kind = df.schema[id_col].dataType
        return out.select(F.col("row").cast(kind).alias(id_col), "n_shingles", F.col("first").cast(kind).alias("component_id"))
    ids = keyed.select("row", "id")
    firsts = ids.select(F.col("row").alias("first"), F.col("id").alias("component_id"))
    return out.join(ids, "row").join(firsts, "first").select(F.col("id").alias(id_col), "n_shingles", "component_id")


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark, documents(spark, sf_dir))

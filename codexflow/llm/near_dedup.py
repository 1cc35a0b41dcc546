"""MinHash near-dedup with tensored banding and exact verification.

A document's set holds its distinct word shingles as 64-bit hashes. Documents
with equal sets form a class; classes are compared, copies only share their
class's outcome.

Tensored banding: two collections of ``m`` half keys, each made of ``t``
minhashes; a table's key is one half key of each, so ``m * m`` tables need
``2 * m * t`` minhashes instead of ``2 * m * m * t``. At the threshold 0.8 with
m = 10 and t = 2, a linked pair meets in no table with probability
2 * (1 - 0.8**2)**10 = 7e-5, and it falls fast above the threshold.

No bucket is turned into pairs. In each bucket a leader is compared with all
members on their full sets (a star, linear in the bucket). Members at distance
up to 0.5 of it leave the bucket; the others choose the next leader. By the
triangle inequality two linked members (distance up to 0.2) both lie within 0.7
of the first leader that either leaves with, so only members of one leader's
wider circle are still to be compared, and only with members of other
components: in blocks of bounded size, by counting shared shingles. What is
left after ``rounds`` leaders is compared in blocks by bucket. So no link is
lost and no step holds more than two blocks at once.

Nulls and edges: null and empty texts, and texts without words, have an empty
set, link with nothing and stay on their own. Rows with a null ``doc_id``
belong to their class but name no component; a component of only such rows has
a null ``component_id`` and ``kept`` false. Rows that share a ``doc_id`` each
give a row by their own text. An empty table gives no rows. Other columns are
not read. Equal sets are told by 64-bit hashes of the sorted set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm import common
from codexflow.llm.encode import _Kept, column

HALF_KEYS, HALF_SIZE = 10, 2
#: Leaders chosen in one bucket before the rest is compared in blocks.
ROUNDS = 3
#: Shingles in one block of the exact comparison: a few MB, whatever the lengths.
BLOCK = 400_000
#: Members of one leader that are compared in one go.
MEMBERS = 256
_TIGHT, _LOOSE = 50, 30

_ROWS = 256
_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
_words = _Kept(lambda w: xxhash.xxh64_intdigest(w), 200_000)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles.

    Letters A-Z count as lower case; words are split at ASCII white space.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, _U)
    h = np.fromiter(map(_words.__getitem__, found), _U, len(found))
    size = min(words, len(h))
    x = np.full(len(h) - size + 1, size, _U)
    for i in range(size):
        x = _mixed(x * _PRIME + h[i : len(h) - size + 1 + i])
    return np.unique(x)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**63, n, dtype=_U), rng.integers(0, 2**63, n, dtype=_U) << _U(1) | _U(1)


def half_keys(shingles: np.ndarray, m: int, t: int, made=None) -> np.ndarray:
    """The 2 * m half keys of a set, each of t minhashes."""
    xor, times = made or _functions(2 * m * t)
    least = np.full(len(xor), ~_U(0))
    for at in range(0, len(shingles), 4096):
        x = (shingles[at : at + 4096, None] ^ xor) * times
        np.minimum(least, (x ^ (x >> _U(32))).min(axis=0), out=least)
    key = np.zeros(2 * m, _U)
    for part in least.reshape(2 * m, t).T:
        key = _mixed(key * _PRIME + part)
    return key


def describe(documents: DataFrame, words: int, m: int = HALF_KEYS, t: int = HALF_SIZE) -> DataFrame:
    """The written table: ``doc_id``, ``n_shingles``, ``node`` (of the set; null if empty), ``half``, ``text_hash``."""

    def work(batches):
        made = _functions(2 * m * t)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                sets = [shingle_set(x, words) for x in column(batch, "text")]
                node = [xxhash.xxh64_intdigest(s.tobytes()) - 2**63 if len(s) else None for s in sets]
                half = [half_keys(s, m, t, made).view(np.int64) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column(batch, "doc_id"), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(half, pa.list_(pa.int64())), batch.column(2)],
                    ["doc_id", "n_shingles", "node", "half", "text_hash"],
                )
        _words.forget()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return common.write_table(docs.mapInArrow(work, "doc_id long, n_shingles long, node long, half array<long>, text_hash long"), "shingles")


def buckets(described: DataFrame, m: int = HALF_KEYS) -> DataFrame:
    """The written ``(key, node)`` rows of the tables' buckets with more than one class."""
    classes = described.filter("node is not null").groupBy("node").agg(F.first("half").alias("half"))
    a, b = f"slice(half, 1, {m})", f"slice(half, {m + 1}, {m})"
    keys = classes.select("node", F.expr(f"explode(flatten(transform({a}, (x, i) -> transform({b}, (y, j) -> xxhash64(i, j, x, y))))) as key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    return common.write_table(keys.join(shared, "key"), "buckets")


def packed_texts(documents: DataFrame, described: DataFrame, nodes: DataFrame) -> DataFrame:
    """The written table of one compressed text for each of ``nodes``: ``node``, ``n``, ``packed``."""
    # The greatest struct has an id wherever one of the rows has one, so it is found by one row or few.
    named = described.join(nodes, "node", "left_semi")
    one = named.groupBy("node").agg(F.max(F.struct("doc_id", "text_hash")).alias("one"), F.first("n_shingles").alias("n")).select("node", "n", "one.*")

    def work(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                packed = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in column(batch, "text")]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["node", "n", "packed"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = docs.alias("d").join(one.alias("o"), F.expr("d.doc_id <=> o.doc_id and d.text_hash = o.text_hash")).select("node", "n", "text").mapInArrow(work, "node long, n long, packed binary")
    return common.write_table(found.dropDuplicates(["node"]), "texts", compression="none")


class _Sets:
    """Sets of packed texts, the last few kept."""

    def __init__(self, words: int):
        self._words, self._unpack, self._kept = words, zstandard.ZstdDecompressor(), {}

    def made(self, packed: bytes) -> np.ndarray:
        return shingle_set(self._unpack.decompress(packed).decode("utf-8", "surrogatepass"), self._words)

    def of(self, node: int, packed: bytes) -> np.ndarray:
        found = self._kept.get(node)
        if found is None:
            if len(self._kept) >= 256:
                self._kept.clear()
            found = self._kept[node] = self.made(packed)
        return found


def compare_pairs(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The written ``(a, b)`` rows with ``shared`` and ``total``: sizes of intersection and union.

    Members ``b`` are dealt out in blocks of ``MEMBERS`` for each leader ``a``;
    the leader's text goes to each block once, and is sorted before its members.
    """

    def work(batches):
        sets, leader, x = _Sets(words), None, None
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                out = []
                for r in whole.slice(at, _ROWS).to_pylist():
                    if r["a"] != leader:
                        leader, x = r["a"], sets.made(r["packed"])
                    if r["b"] is not None:
                        y = sets.of(r["b"], r["packed"])
                        shared = len(np.intersect1d(x, y, assume_unique=True))
                        out.append((r["a"], r["b"], shared, len(x) + len(y) - shared))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["a", "b", "shared", "total"])

    leaders = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    leaders = common.write_table(leaders.join(texts.select(F.col("node").alias("a"), F.col("n").alias("na")), "a"), "leaders")
    right = texts.select(F.col("node").alias("b"), F.col("n").alias("nb"), "packed")
    # Sizes bound the similarity: pairs whose sizes forbid the wider circle need no comparison.
    size = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * _LOOSE
    members = pairs.join(leaders, "a").join(right, "b").filter(size).select("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), "b", "packed")
    first = leaders.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    first = first.join(texts.select(F.col("node").alias("a"), "packed"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "packed")
    rows = first.unionByName(members).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))
    return common.write_table(rows.select("a", "b", "packed").mapInArrow(work, "a long, b long, shared long, total long"), "compared")


def components(links: DataFrame) -> DataFrame:
    """The written ``(node, root)`` of all nodes in links: the least node reachable.

    Each level hooks every node to its least neighbour, follows the hooks to
    their ends by doubling, and keeps only the links between different ends.
    At least half of the nodes go with each level, and the links with them.
    """
    edges = common.write_table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    roots = None
    while True:
        ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("a").alias("next")), F.struct(F.col("b").alias("node"), F.col("a").alias("next"))))
        hooks = common.write_table(edges.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.min("next").alias("next")), "hooks")
        while True:
            far = hooks.select(F.col("node").alias("next"), F.col("next").alias("far"))
            jumped = common.write_table(hooks.join(far, "next").select("node", F.col("far").alias("next"), (F.col("far") != F.col("next")).alias("moved")), "hooks")
            hooks = jumped.select("node", "next")
            if not jumped.filter("moved").limit(1).count():
                break
        if roots is None:
            roots = hooks.withColumnRenamed("next", "root")
        else:
            far = hooks.select(F.col("node").alias("root"), "next")
            roots = common.write_table(roots.join(far, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        low = hooks.select(F.col("node").alias("a"), F.col("next").alias("ra"))
        high = hooks.select(F.col("node").alias("b"), F.col("next").alias("rb"))
        between = edges.join(low, "a").join(high, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = common.write_table(between.distinct(), "links")
        if not edges.limit(1).count():
            return roots


def _linked(compared: DataFrame) -> DataFrame:
    return compared.filter("100 * shared >= 80 * total").select("a", "b")


def _group_links(groups: DataFrame, roots: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Links between different components within groups ``(grp, node)``, compared in blocks.

    ``grp`` has its main component, that of its least node; members of others
    are the queries. A block holds about ``BLOCK`` shingles of members or queries.
    """
    # Each table is written, so that a hot group's rows are only added up, or split by the join's skew handling.
    at = common.write_table(groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(texts.select("node", "n"), "node"), "members")
    parts = at.groupBy("grp", "root").agg(F.min("node").alias("least"), F.sum("n").alias("n"))
    held = F.sum("n").alias("held"), (F.sum("n") - F.min_by("n", "least")).alias("asked")
    sizes = parts.groupBy("grp").agg(F.min_by("root", "least").alias("main"), *held, F.count("*").alias("roots")).filter("roots > 1")
    sizes = common.write_table(sizes.select("grp", "main", "held", "asked"), "sizes")
    # Members meet their group's sizes in one join, whose rows are read twice.
    at = common.write_table(at.join(sizes, "grp").withColumn("query", F.col("root") != F.col("main")), "members")
    # A member's text is joined once, and then sent to its blocks.
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    place = lambda c: F.pmod(F.xxhash64("node"), blocks(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    data = F.transform(every("asked"), lambda j: F.struct(F.lit(False).alias("query"), place("held").alias("i"), j.alias("j")))
    asked = F.transform(every("held"), lambda i: F.struct(F.lit(True).alias("query"), i.alias("i"), place("asked").alias("j")))
    sent = F.explode(F.when(F.col("query"), F.concat(data, asked)).otherwise(data))
    rows = at.join(texts.select("node", "packed"), "node").select("grp", "node", "root", "packed", sent.alias("to")).select("grp", "node", "root", "packed", "to.*")

    def compare(key, table):
        sets = _Sets(words)
        rows = table.select(["node", "root", "query", "packed"]).to_pylist()
        data = [r for r in rows if not r["query"]]
        queries = [r for r in rows if r["query"]]
        a, b = [], []
        if data and queries:
            members = [sets.of(r["node"], r["packed"]) for r in data]
            sizes = np.array([len(m) for m in members])
            tokens = np.concatenate(members)
            owner = np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            # Components of this block, joined as links are found.
            label = np.array([r["root"] for r in data])
            joined: dict[int, int] = {}
            for r in queries:
                own = r["root"]
                while own in joined:
                    own = joined[own]
                if (label == own).all():
                    continue
                x = sets.of(r["node"], r["packed"])
                lo, hi = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
                n = hi - lo
                index = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                shared = np.bincount(owner[index], minlength=len(members))
                ok = (100 * shared >= 80 * (sizes + len(x) - shared)) & (label != own)
                # One link to each component not yet joined says as much as all, so a block's links are fewer than its components.
                found, first = np.unique(label[ok], return_index=True)
                for other, k in zip(found.tolist(), np.flatnonzero(ok)[first].tolist()):
                    a.append(r["node"])
                    b.append(data[k]["node"])
                    joined[other] = own
                    label[label == other] = own
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("grp", "i", "j").applyInArrow(compare, "a long, b long")


def near_links(documents: DataFrame, described: DataFrame, words: int, m: int = HALF_KEYS, rounds: int = ROUNDS) -> DataFrame:
    """The written ``(node, root)`` of all classes that link with another one."""
    pool = buckets(described, m)
    texts = packed_texts(documents, described, pool.select("node").distinct())
    compared, circles = None, None
    for _ in range(rounds):
        leaders = pool.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
        stars = pool.join(leaders, "key").filter("node <> a").select("key", "a", F.col("node").alias("b"))
        pairs = stars.select("a", "b").distinct()
        found = compare_pairs(pairs if compared is None else pairs.join(compared, ["a", "b"], "left_anti"), texts, words)
        compared = found if compared is None else compared.unionByName(found)
        close = compared.filter(f"100 * shared >= {_TIGHT} * total").select("a", "b")
        pool = common.write_table(stars.join(close, ["a", "b"], "left_anti").select("key", F.col("b").alias("node")), "pool")
    circles = compared.filter(f"100 * shared >= {_LOOSE} * total")
    roots = components(_linked(compared))
    groups = circles.select(F.col("a").alias("grp"), F.col("b").alias("node")).unionByName(circles.select(F.col("a").alias("grp"), F.col("a").alias("node"))).distinct()
    rest = pool.select(F.col("key").alias("grp"), "node")
    more = common.write_table(_group_links(groups, roots, texts, words).unionByName(_group_links(rest, roots, texts, words)), "links")
    return components(_linked(compared).unionByName(more))


def dedup(documents: DataFrame, words: int, m: int = HALF_KEYS, t: int = HALF_SIZE) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, and ``root`` and ``text_hash`` that tell components and texts."""
    described = describe(documents, words, m, t)
    roots = near_links(documents, described, words, m)
    base = described.select("doc_id", "n_shingles", "node", "text_hash")
    # A class has one row here, however many copies it has.
    classes = base.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = common.write_table(classes.join(ids, "root").select("node", "root", "component_id"), "classes")
    out = base.join(classes, "node", "left")
    whole = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(False)).alias("kept"), "root", "text_hash")


def drop_near_copies(documents: DataFrame, words: int = 5) -> DataFrame:
    """The documents with one row of each component left, with all their columns.

    It is the row of the least id; of several with that id, one with the least
    hash of its text; of equal rows, any one. Different texts of one id that
    aren't linked are all left, as are rows without words.
    """
    found = common.write_table(dedup(documents, words), "components")
    rows = found.filter("root is not null").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash", "rows")).alias("best")).select("best.*")
    empty = found.filter("root is null").select("doc_id", "text_hash", F.lit(1).cast("long").alias("rows")).distinct()
    kept = common.write_table(best.select("doc_id", "text_hash", "rows").unionByName(empty), "kept")
    hash_of = F.xxhash64(common.text_or_empty())

    def left(which: DataFrame) -> DataFrame:
        which = which.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        return documents.join(which, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (hash_of == F.col("_hash")), "left_semi")

    out = left(kept.filter("rows = 1"))
    if kept.filter("rows > 1").limit(1).count():
        again = left(kept.filter("rows > 1")).withColumn("_hash", hash_of).dropDuplicates(["doc_id", "_hash"]).drop("_hash")
        out = out.unionByName(again)
    return out


def op2_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(common.read(spark, sf_dir, "documents"), words=4).drop("root", "text_hash")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP2_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM parts a JOIN parts b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), reach(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.y, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(l.y, s.doc_id)) AS kept
FROM sets s LEFT JOIN least l ON l.x = s.doc_id
"""

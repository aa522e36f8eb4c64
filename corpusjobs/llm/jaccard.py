"""Operator 8: exact n-gram Jaccard join by size-aware heavy-light search, and its components.

Equal sets are one class. Between classes, two sets that reach the threshold miss few members of each other:

- Light: a small set of n members shares a subset of fixed size n - k with each partner that is small too, k at
  most (1 - t) n. It enumerates these subsets; equal subsets meet.
- Heavy: large sets stand in inverted lists and lists are scanned. A list of a single shingle would hold every
  document that quotes a common passage, so the lists' terms are segments: all members of a set whose hashes fall
  in one of p parts. Linked sets of a size class differ in fewer than p members, so they share a whole segment.

The boundary between light and heavy sets is the one with the least cost over the sizes that occur: keys that
are made, and entries that are scanned at `SCAN` times that cost. Sets that meet in a list form clusters around
the list's smallest class. Clusters are cut into blocks of at most `BLOCK` sets and `BLOCK_SHINGLES` shingles;
a block moves once, and those of larger clusters are written to the shared folder, where each pair of blocks is read
and all its overlaps are counted exactly. A spanning forest of the links is returned, never the pairs. Nothing is
capped or sampled.

Words and shingles are 64-bit hashes, and a class is the 120-bit hash of its set: n sets are told apart but for a
chance of about n**2 / 2**121. Defined cases: a document without words has no shingles, is linked with nothing
and is its own component; a very long text is one set; repeated rows and equal texts are one class; rows with a null
doc_id link others as any do; the component of rows whose doc_ids are all null is null; an empty table gives no rows;
join() reads doc_id and text alone, keep_one() returns all columns whatever their names.
"""

from __future__ import annotations

import uuid
from decimal import Decimal
from math import comb, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, StructField, StructType

from .common import SPACE_WORDS, Words, fs_of, lean, mix, pieces, shared_dir, table, table_of, unused, utf8, with_text
from .components import components

BLOCK, BLOCK_SHINGLES, SCAN = 800, 1 << 20, 6
HOPS = 1
U = np.uint64


class Rule:
    """Sets of k-word shingles, linked where den * intersection >= num * union."""

    def __init__(self, k: int, num: int, den: int):
        self.k, self.num, self.den = k, num, den
        self.upper = [0]  # of each size class
        while self.upper[-1] < 1 << 32:
            self.upper.append((self.upper[-1] + 1) * den // num)
        self.uppers = np.array(self.upper, np.int64)
        most = (self.uppers + self.uppers * den // num) * (den - num) // (den + num)  # members that linked sets differ in
        spare = [(1, 0)] + [self._spare(int(u) + 1, int(d)) for u, d in zip(self.uppers, most[1:])]
        self.spare, self.thin = (np.array(x, np.int64) for x in zip(*spare))
        self.parts = most + self.spare

    @staticmethod
    def _spare(n: int, most: int) -> tuple[int, int]:
        """Parts beyond `most`, and the members below which a part is thin: a set of n members has usually fewer
        thin parts than there are spare ones."""
        for thin in (2, 1):
            for spare in range(1, min(most // 4, 4096) + 2):
                rate = n / (most + spare)
                mean = (most + spare) * exp(-rate) * (1 + rate if thin == 2 else 1)
                if spare > mean + 3 * sqrt(mean):
                    return spare, thin
        return 1, 0

    def missing(self, n):
        return n * (self.den - self.num) // self.den

    def has_partners(self, n):
        """Whether a set of n members can be linked with a set that isn't equal."""
        return self.missing(n) > 0 or n * self.den // self.num > n

    def heavy_keys(self, n: int) -> int:
        i = int(np.searchsorted(self.uppers, n))
        return int(self.parts[i] + (self.parts[i - 1] if i > 1 else 0))

    def light_keys(self, n: int) -> int:
        return sum(comb(n, j) for j in range(self.missing(n) + 1))

    def boundary(self, sizes: dict[int, int]) -> int:
        """Sets below this size are light. sizes: number of sets of each size below that of three misses."""
        cost = lambda x: sum(c * (self.light_keys(n) if n < x else 0) + c * (self.heavy_keys(n) * (1 + SCAN) if n >= x * self.num // self.den else 0) for n, c in sizes.items())
        return min(self.boundaries(), key=lambda x: (cost(x), x))

    def boundaries(self) -> list[int]:
        """Sizes at which sets may miss one, two and three members."""
        return [next(n for n in range(1, 10_000) if self.missing(n) >= j) for j in (1, 2, 3)]

    def most_light(self) -> int:
        return self.boundaries()[-1]


def sets_of(data: np.ndarray, off: np.ndarray, rule: Rule):
    """The sorted distinct shingles of each document of a piece."""
    words = Words(data, off, SPACE_WORDS)
    bound, k, h = words.bounds(len(off) - 1), rule.k, words.h
    n = max(0, len(h) - k + 1)
    shingles = np.zeros(n, U)
    for j in range(k):
        shingles = mix(shingles * U(0x9FB21C651E98DF25) + h[j : j + n])
    for a, b in zip(bound, bound[1:]):
        if b - a >= k:
            yield np.unique(shingles[a : b - k + 1])
        elif b > a:
            own = np.zeros(1, U)
            for j in range(a, b):
                own = mix(own * U(0x9FB21C651E98DF25) + h[j : j + 1])
            yield mix(own + U(b - a))
        else:
            yield np.zeros(0, U)


def class_of(own: np.ndarray) -> int:
    """The set's class, a number of 120 bits."""
    with np.errstate(over="ignore"):
        sums = np.array([mix(own + U(1)).sum(dtype=U), mix(own ^ U(0xA24BAED4963EE407)).sum(dtype=U)], U)
        high, low = mix(sums * U(31) + U(len(own))).tolist()
    return (high >> 8) << 64 | low


def numbers(classes: list[int]) -> pa.Array:
    """Classes as a column."""
    return pa.array([Decimal(c) for c in classes], pa.decimal128(38, 0))


def keys_of(own: np.ndarray, rule: Rule, boundary: int) -> np.ndarray:
    """Keys under which a set is looked for: subsets if it's light, segments if a heavy partner may exist."""
    n, out = len(own), []
    with np.errstate(over="ignore"):
        if n < boundary and rule.has_partners(n):
            e = mix(own + U(1))
            total = e.sum(dtype=U)
            subsets = [np.array([total], U)]
            if rule.missing(n) >= 1:
                subsets.append(total - e)
            if rule.missing(n) >= 2:
                i, j = np.triu_indices(n, 1)
                subsets.append(total - e[i] - e[j])
            out += [mix(s * U(3) + U(n - m)) for m, s in enumerate(subsets)]
        if n >= boundary * rule.num // rule.den:
            i = int(np.searchsorted(rule.uppers, n))
            for scheme in (i, i - 1):
                if scheme < 1:
                    continue
                p, tag = int(rule.parts[scheme]), U(scheme << 32)
                part = (mix(own ^ U(0x5851F42D4C957F2D + scheme)) % U(p)).astype(np.int64)
                sums = np.zeros(p, U)
                np.add.at(sums, part, mix(own + U(7)))
                keys = mix(sums + (np.arange(p, dtype=U) + tag) * U(0xD6E8FEB86659FD93))
                thin = np.bincount(part, minlength=p) < rule.thin[scheme]
                out.append(keys[~thin] if thin.sum() < rule.spare[scheme] else keys)
    return np.concatenate(out) if out else np.zeros(0, U)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of some sets."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, U)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(flat)))
    out = np.zeros((m, m), np.float32)
    dense = first[n > max(8, m // 16)], n[n > max(8, m // 16)]
    for lo in range(0, len(dense[0]), 2048):
        x = np.zeros((m, min(2048, len(dense[0]) - lo)), np.float32)
        for c, (a, k) in enumerate(zip(dense[0][lo : lo + 2048], dense[1][lo : lo + 2048])):
            x[owner[a : a + k], c] = 1
        out += x @ x.T
    counted = np.zeros(m * m, np.int64)
    for k in np.unique(n[(n > 1) & (n <= max(8, m // 16))]):
        at = owner[first[n == k][:, None] + np.arange(k)]
        for j in range(1, k):
            counted += np.bincount((at[:, :-j] * m + at[:, j:]).ravel(), minlength=m * m) if m <= 256 else 0
            if m > 256:
                np.add.at(counted, (at[:, :-j] * m + at[:, j:]).ravel(), 1)
    counted = counted.reshape(m, m)
    return out.astype(np.int64) + counted + counted.T


def forest(nodes: list[int], sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """Links that join each set with the smallest one that it reaches."""
    size = np.array([len(s) for s in sets], np.int64)
    both = overlaps(sets)
    linked = rule.den * both >= rule.num * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, True)
    label = np.arange(len(nodes))
    while True:
        new = np.where(linked, label[None, :], len(nodes)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return [(nodes[i], nodes[k]) for i, k in enumerate(label) if i != k]


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n, node: the set size and class of each document."""

    def run(batches):
        for batch in batches:
            n, node = [], []
            for _, _, data, off in pieces(*utf8(batch.column(1))):
                for own in sets_of(data, off, rule):
                    n.append(len(own))
                    node.append(class_of(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), numbers(node)], ["doc_id", "n", "node"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n long, node decimal(38, 0)")


def clusters(docs: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """pivot, node: classes that meet in a list, under the list's smallest class."""

    def run(batches):
        seen: set[int] = set()  # classes that this task has sent already
        for batch in batches:
            for _, _, data, off in pieces(*utf8(batch.column(0))):
                keys, nodes = [], []
                for own in sets_of(data, off, rule):
                    if len(own) and rule.has_partners(len(own)) and (node := class_of(own)) not in seen:
                        seen.add(node)
                        keys.append(keys_of(own, rule, boundary))
                        nodes.append(node)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), numbers(nodes).take(pa.array(np.repeat(np.arange(len(nodes)), [len(k) for k in keys])))], ["key", "node"])

    entries = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "key long, node decimal(38, 0)")
    own = Window.partitionBy("key")
    met = entries.select("node", F.min("node").over(own).alias("pivot"), F.max("node").over(own).alias("top")).filter("pivot <> top").select("pivot", "node").distinct()
    for _ in range(HOPS):  # a pivot that is in a smaller one's cluster hands its own to it, so sets stand in few clusters
        met = table_of(met, "clusters")
        best = met.groupBy(F.col("node").alias("pivot")).agg(F.min("pivot").alias("best"))
        met = met.join(best, "pivot").select(F.col("best").alias("pivot"), "node").distinct()
    return table_of(met, "clusters")


def links(docs: DataFrame, sets: DataFrame, rule: Rule, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """u, v: links between classes that connect all that are linked."""
    most = rule.most_light()
    by_class = table_of(sets.filter("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id")), "classes")
    sizes = {r.n: r["count"] for r in by_class.filter(F.col("n") < 2 * most).groupBy("n").count().collect()}  # 2 * most rows at most
    met = clusters(docs, rule, rule.boundary(sizes)).join(by_class, "node")
    total = met.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("blocks"))
    placed = met.join(total, "pivot").withColumn("b", F.pmod(F.xxhash64("node", "pivot"), F.col("blocks")).cast("int"))
    needed = placed.groupBy("node", "doc_id").agg(F.collect_list(F.struct("pivot", "b", "blocks")).alias("places"))

    def named(batches):
        seen: set[tuple] = set()  # rows that repeat an id and a class are sent once by a task
        for batch in batches:
            node, new = [], []
            for _, _, data, off in pieces(*utf8(batch.column(1))):
                node += [class_of(own) for own in sets_of(data, off, rule)]
            for row in zip(batch.column(0).to_pylist(), node):
                new.append(row not in seen)
                seen.add(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), numbers(node), batch.column(1)], ["doc_id", "node", "text"]).filter(pa.array(new, pa.bool_()))

    def run(batches):
        for batch in batches:
            sets = []
            for _, _, data, off in pieces(*utf8(batch.column(1))):
                sets += sets_of(data, off, rule)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "places", "members"])

    own = F.struct("doc_id", "node").alias("own")  # equal where both ids are null, too
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(named), f"doc_id {dict(docs.dtypes)['doc_id']}, node decimal(38, 0), text string")
    texts = texts.select(own, "text").join(needed.select(own, "places"), "own").select("own.node", "text", "places")
    members = texts.mapInArrow(lean(run), "node decimal(38, 0), places array<struct<pivot: decimal(38, 0), b: int, blocks: int>>, members binary")
    dealt = members.select("node", "members", F.explode("places").alias("p")).select("p.pivot", "p.b", "p.blocks", "node", "members").repartition("pivot", "b").sortWithinPartitions("pivot", "b")
    folder = shared_dir(docs.sparkSession, "cluster-blocks")
    edges = lambda out: [numbers([u for u, _ in out]), numbers([v for _, v in out])]

    def inner(batches):
        at, nodes, raws, held, name = None, [], [], set(), "u v pivot b name".split()

        def ended():
            """The links of a block, and where it stands for the others of its cluster."""
            out = forest(nodes, [np.frombuffer(r, U) for r in raws], rule) if len(nodes) > 1 else []
            yield pa.RecordBatch.from_arrays([*edges(out), *(pa.nulls(len(out), t) for t in (pa.decimal128(38, 0), pa.int32(), pa.string()))], name)
            if at is not None and at[2] > 1:
                file = _written(folder, nodes, raws)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.decimal128(38, 0))] * 2, numbers([at[0]]), pa.array([at[1]], pa.int32()), pa.array([file])], name)

        for batch in batches:
            for p, b, blocks, node, raw in zip(*(batch.column(k) for k in range(5))):
                key = (p.as_py(), b.as_py(), blocks.as_py())
                if key != at:
                    yield from ended()
                    at, nodes, raws, held = key, [], [], set()
                if node.as_py() not in held:  # a repeated row
                    held.add(node.as_py())
                    nodes.append(node.as_py())
                    raws.append(raw.as_py())
        yield from ended()

    def outer(batches):
        left = None, [], []
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x != left[0]:
                    left = x, *_block(folder, x)
                nodes, sets = _block(folder, y)
                yield pa.RecordBatch.from_arrays(edges(forest(left[1] + nodes, left[2] + sets, rule)), ["u", "v"])

    # members move once for each of their clusters; pairs of blocks of one cluster, which are quadratic, are only named
    found = table_of(dealt.mapInArrow(lean(inner), "u decimal(38, 0), v decimal(38, 0), pivot decimal(38, 0), b int, name string"), "block-links")
    own = found.filter("name is null").select("u", "v")
    written = found.filter("name is not null")
    pairs = written.select("pivot", "b", F.col("name").alias("x")).join(written.select("pivot", F.col("b").alias("c"), F.col("name").alias("y")), "pivot").filter("b < c").select("x", "y")
    many = pairs.count()
    if not many:
        return own
    spark = docs.sparkSession  # rows are small, so Spark wouldn't part them by itself
    parts = min(many, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    return own.unionByName(pairs.repartition(parts, "x", "y").sortWithinPartitions("x", "y").mapInArrow(lean(outer), "u decimal(38, 0), v decimal(38, 0)"))


def _written(folder: str, nodes: list[int], raws: list[bytes]) -> str:
    """The name of a new file in the shared folder with the classes of a block and the bytes of their members."""
    fs, base = fs_of(folder)
    fs.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    own = pa.table({"node": numbers(nodes), "members": pa.array(raws, pa.large_binary())})
    with fs.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_stream(out, own.schema) as file:
        file.write_table(own)
    return name


def _block(folder: str, name: str) -> tuple[list[int], list[np.ndarray]]:
    fs, base = fs_of(folder)
    with fs.open_input_stream(f"{base}/{name}") as file:
        own = pa.ipc.open_stream(file).read_all()
    return [int(x) for x in own["node"].to_pylist()], [np.frombuffer(x, U) for x in own["members"].to_pylist()]


def rooted_classes(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The classes of the documents; and node, least (its smallest doc_id), root of each class with words."""
    sets = table_of(classes(docs, rule), "sets")
    roots = components(links(docs, sets, rule))
    by_class = sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    return sets, by_class.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    sets, rooted = rooted_classes(docs, Rule(k, num, den))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = rooted.join(least, "root").select("node", "component_id")
    with_words = sets.filter("n > 0").join(told, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(sets.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component, that with the smallest doc_id and class, in the columns of docs.

    Null ids come after all others. Of rows that share the id and the class, the one with the least hash of its text
    stays; rows without words are copies only of those with the same id.
    """
    rule = Rule(k, num, den)
    sets, rooted = rooted_classes(docs, rule)
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), "node")).alias("first"))
    kept = first.select("first.doc_id", "first.node").unionByName(sets.filter("n = 0").select("doc_id", "node").distinct())
    rows, text = with_text(docs)
    at, hidden = rows.columns.index(text), unused("__node", rows.columns)

    def run(batches):
        for batch in batches:
            node = []
            for _, _, data, off in pieces(*utf8(batch.column(at))):
                node += [class_of(own) for own in sets_of(data, off, rule)]
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers(node)], [*batch.schema.names, hidden])

    named = rows.mapInArrow(lean(run), StructType([*rows.schema.fields, StructField(hidden, DecimalType(38, 0))]))
    one = named.groupBy(F.struct("doc_id", F.col(hidden).alias("node")).alias("own")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text)).alias("row"))
    return one.join(kept.select(F.struct("doc_id", "node").alias("own")), "own", "left_semi").select("row.*")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))

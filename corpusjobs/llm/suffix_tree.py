"""Operator 9: language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of the lower-cased words, a space after each word, and a zero byte at a text's end, so a
text's probability is that of its sequence of words. Counts of all contexts of up to `DEPTH` symbols with their
next symbols are gathered from every training document. A context is a candidate where it occurs `LEAST` times or
more, so states grow with the input, and is retained where its next symbols diverge from those of its suffix:
n(s) KL(P(.|s) || P(.|suffix of s)) must exceed the number of its different next symbols. Suffixes of retained
contexts are states too. A state's distribution is smoothed towards its suffix's by its number of different next
symbols; the root's by a half. Each symbol of a text is scored in the state of the longest suffix of what stands
before it.

The tree is never held whole: it falls into parts of about `PART_CONTEXTS` candidates, those that end in the same
two symbols together (the states of fewer symbols stand in each part). A group of rows builds a part and writes it
to the shared folder; a task holds one part at a time and scores the symbols that fall in it, for `HELD` bytes of
text before it takes the next. Larger trees cost more reading, not more memory. (A part is larger only where the
contexts that end in one pair of symbols are more than that.)

The unigram base needs the exact count of every word: documents are inverted in runs of about `RUN_WORDS` words, whose
postings stay in a file in the shared folder. Only a row for each run and word goes through an exchange to the word's
count (very common words meet theirs by broadcast, see join_hot()) and back to its run, where the counts meet the
postings. The end, which all texts have, needs none.

Defined cases: a null or empty text is an end alone; a very long one is scored whole; a null doc_id is in the fold of
the empty text; repeated rows are scored each; without training documents every count is 0 and states are the root
alone; an empty table gives no rows; columns besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import REMEMBERED, SPACE_WORDS, Words, _LOWER, fold_of, fs_of, give_back, join_hot, lean, pieces, shared_dir, table, table_of, utf8

DEPTH, LEAST = 6, 256
PART_CONTEXTS, HELD = 100_000, 16 << 20
RUN_WORDS, RUN_DOCS, MOST_CODES = 2_000_000, 60_000, 2_000_000
PIECE = 1 << 19  # bytes that are worked on at once


def symbols_of(data: np.ndarray, off: np.ndarray, words: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a piece with depth zeros before each text; the rows of the symbols to score, see places()."""
    rows, size = len(off) - 1, words.end - words.start
    n_words = np.bincount(words.row, minlength=rows)
    n_bytes = np.bincount(words.row, size, rows).astype(np.int64)
    length = n_words + n_bytes + 1
    first = depth + np.cumsum(length + depth - 1) - (length + depth - 1)
    out = np.zeros(int(first[-1] + length[-1]) if rows else 0, np.uint8)
    before = np.cumsum(size) - size  # word bytes before each word
    doc_before = np.cumsum(n_bytes) - n_bytes
    doc_words = np.cumsum(n_words) - n_words
    start = first[words.row] + before - doc_before[words.row] + np.arange(len(size)) - doc_words[words.row]
    place = np.repeat(start - before, size) + np.arange(int(size.sum()))
    out[place] = _LOWER[data[np.repeat(words.start - before, size) + np.arange(int(size.sum()))]]
    out[start + size] = 32
    row = np.repeat(np.arange(rows), length)
    return out, row.astype(np.uint16 if rows < 1 << 16 else np.int32)


def places(row: np.ndarray, depth: int) -> np.ndarray:
    """Where the symbols to score stand, given their rows: each text but the first brings one zero less than depth."""
    return np.arange(depth, depth + len(row), dtype=np.int32) + row * np.int32(depth - 1)


def gather(docs: DataFrame, depth: int) -> DataFrame:
    """code, n: how often each symbol (lowest byte) follows each context (next bytes, nearest first)."""

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        return codes[first], np.add.reduceat(counts, first) if len(first) else counts

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, data, off in pieces(*utf8(batch.column(0)), 2 * PIECE):
                s, row = symbols_of(data, off, Words(data, off, SPACE_WORDS), depth)
                at = places(row, depth)
                own = np.zeros(len(at), np.int64)
                for d in range(depth + 1):
                    own |= s[at - d].astype(np.int64) << (8 * d)
                held.append(np.unique(own, return_counts=True))
                size += len(held[-1][0])
                if size > MOST_CODES:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > MOST_CODES // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], ["code", "n"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged(held))), ["code", "n"])

    return docs.mapInArrow(lean(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class SuffixTree:
    """States numbered by depth from 1, the root; child[state, symbol] is 0 where there is none."""

    def __init__(self, symbol: np.ndarray, unseen: int, child: np.ndarray, logs: np.ndarray, depth: int):
        self.symbol, self.unseen, self.child, self.logs, self.depth = symbol, unseen, child, logs, depth

    @classmethod
    def build(cls, levels: list[tuple[np.ndarray, np.ndarray]]) -> SuffixTree:
        """levels: for each context length the codes and counts of candidates with their next symbols, by code."""
        used = np.unique(np.concatenate([c & 255 for c, _ in levels] + [np.array([0, 32])]))
        symbol = np.full(256, len(used), np.int64)  # the last one stands for bytes never seen
        symbol[used] = np.arange(len(used))
        a, unseen = len(used) + 1, max(1, 256 - len(used))
        root = np.full((1, a), 0.5)
        root[0, symbol[levels[0][0] & 255]] += levels[0][1]
        root[0, -1] = 0.5 * (256 - len(used))
        known, smooth, wanted, parents = [np.zeros(1, np.int64)], [root / root.sum()], [np.ones(1, bool)], [None]
        for d, (code, n) in enumerate(levels[1:], 1):
            context = code >> 8
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(code) else np.zeros(0, np.int64)
            different = np.diff(np.append(first, len(code)))
            contexts = context[first]
            parent = np.searchsorted(known[d - 1], contexts & ((1 << (8 * (d - 1))) - 1))
            row, at, m = np.repeat(np.arange(len(first)), different), symbol[code & 255], n.astype(float)
            own = smooth[d - 1][parent].astype(float)
            own *= different[:, None]
            own[row, at] += m
            total = np.add.reduceat(m, first) if len(first) else m
            own /= own.sum(axis=1, keepdims=True)
            diverged = m * np.log(m / total[row] / smooth[d - 1][parent[row], at])
            known.append(contexts)
            smooth.append(own.astype(np.float32))
            parents.append(parent)
            wanted.append((np.add.reduceat(diverged, first) if len(first) else diverged) > different)
        for d in range(len(levels) - 1, 1, -1):
            wanted[d - 1][parents[d][wanted[d]]] = True
        ids, count = [np.ones(1, np.int64)], 2
        for w in wanted[1:]:
            ids.append(np.where(w, count + np.cumsum(w) - 1, 0))
            count += int(w.sum())
        child = np.zeros((count, a), np.int32)
        for d in range(1, len(levels)):
            w = wanted[d]
            child[ids[d - 1][parents[d][w]], symbol[known[d][w] >> (8 * (d - 1))]] = ids[d][w]
        logs = np.zeros((count, a), np.float32)
        with np.errstate(divide="ignore"):
            logs[1:] = np.log10(np.concatenate([p[w] for p, w in zip(smooth, wanted)]))
        logs[1:, -1] -= np.log10(unseen)  # shared among the bytes never seen
        return cls(symbol, unseen, child, logs, len(levels) - 1)

    def score(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 P of the symbols at the places at."""
        own, a = self.symbol[s], self.child.shape[1]
        child, now = self.child.ravel(), np.ones(len(at), np.int32)
        best = now
        for d in range(1, self.depth + 1):
            now = child[now * np.int64(a) + own[at - d]]
            best = np.maximum(best, now)
        return self.logs.ravel()[best * np.int64(a) + own[at]]

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, symbol=self.symbol, child=self.child, logs=self.logs, told=np.array([self.unseen, self.depth]))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> SuffixTree:
        with np.load(io.BytesIO(raw)) as x:
            return cls(x["symbol"], int(x["told"][0]), x["child"], x["logs"], int(x["told"][1]))


class Forest:
    """The parts of a tree in the shared folder; part_of gives the part of the last two symbols, nearest first."""

    def __init__(self, folder: str, parts: int, part_of: np.ndarray, states: int, depth: int):
        self.folder, self.parts, self.part_of, self.states, self.depth = folder, parts, part_of, states, depth

    def part(self, k: int) -> SuffixTree:
        if not self.states:  # nothing to learn from
            return SuffixTree.build([(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (self.depth + 1))
        own = REMEMBERED.setdefault("suffix tree", {})
        if (self.folder, k) not in own:
            own.clear()  # one part at a time
            fs, base = fs_of(self.folder)
            with fs.open_input_file(f"{base}/part-{k}.npz") as file:
                own[self.folder, k] = SuffixTree.load(file.read())
        return own[self.folder, k]

    def score(self, pieces_of: list) -> list[np.ndarray]:
        """The sum of log10 P of each text, for pieces (symbols, the rows of those to score, number of rows)."""
        out, parts = [np.zeros(rows) for *_, rows in pieces_of], [None] * len(pieces_of)
        if self.parts > 1:
            for i, (s, row, _) in enumerate(pieces_of):
                at = places(row, self.depth)
                parts[i] = self.part_of[s[at - 1].astype(np.int32) | s[at - 2].astype(np.int32) << 8]
        for k in range(self.parts):
            tree = self.part(k)
            for total, part, (s, row, rows) in zip(out, parts, pieces_of):
                at = places(row, self.depth)
                if part is not None:
                    mine = np.flatnonzero(part == k)
                    at, row = at[mine], row[mine]
                total += np.bincount(row, tree.score(s, at), rows)
        return out


def fit(train: DataFrame, depth: int = DEPTH, least: int = LEAST, part_contexts: int = PART_CONTEXTS) -> Forest:
    """The tree of the documents of train (text), two symbols deep at least, in parts."""
    spark = train.sparkSession
    own, levels = table_of(gather(train, depth), "contexts"), None
    for d in range(depth, -1, -1):
        if d < depth:
            own = table_of(own.groupBy(F.col("code").bitwiseAND((1 << (8 * (d + 1))) - 1).alias("code")).agg(F.sum("n").alias("n")), "contexts")
        by_context = own.withColumn("context", F.shiftright("code", 8))
        frequent = by_context.groupBy("context").agg(F.sum("n").alias("m")).filter(F.col("m") >= (least if d else 0)).select("context")
        kept = by_context.join(frequent, "context").select(F.lit(d).alias("d"), "code", "n")
        levels = kept if levels is None else levels.unionByName(kept)
    levels = table_of(levels.withColumn("pair", F.when(F.col("d") >= 2, F.shiftright("code", 8).bitwiseAND(65535).cast("int"))), "levels")
    sizes = levels.filter("pair is not null").groupBy("pair").agg(F.countDistinct("d", F.shiftright("code", 8)).alias("n")).orderBy("pair").collect()  # 65,536 rows at most
    part_of, parts, held = np.zeros(65536, np.uint16), 0, 0
    for r in sizes:
        if held and held + r.n > part_contexts:
            parts, held = parts + 1, 0
        part_of[r.pair], held = parts, held + r.n
    parts += 1
    folder = shared_dir(spark, "suffix-tree")
    placed = spark.createDataFrame([(r.pair, int(part_of[r.pair])) for r in sizes], "pair int, part int")
    dealt = levels.join(F.broadcast(placed), "pair").select("part", "d", "code", "n")
    common = levels.filter("pair is null").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "d", "code", "n")

    def build(frame: pa.Table) -> pa.Table:
        give_back("")  # what earlier tasks of the worker have freed
        part, d = frame["part"][0].as_py(), np.asarray(frame["d"])
        code, n = np.asarray(frame["code"]), np.asarray(frame["n"])
        order = np.argsort(code, kind="stable")
        tree = SuffixTree.build([(code[order][d[order] == k], n[order][d[order] == k]) for k in range(depth + 1)])
        states = len(tree.logs) - 1
        _write(folder, f"part-{part}.npz", tree.save())
        del tree, order, code, n
        give_back("")
        return pa.table({"part": pa.array([part], pa.int32()), "states": pa.array([states], pa.int64())})

    built = table_of(dealt.unionByName(common).groupBy("part").applyInArrow(build, "part int, states long"), "parts")
    told = built.agg(F.count("*"), F.coalesce(F.sum("states"), F.lit(0))).first()
    return Forest(folder, max(1, told[0]), part_of, told[1], depth)


def _write(folder: str, name: str, data: bytes) -> None:
    """A file in the shared folder, whole or not at all; a task that runs again leaves what is there, which is the same."""
    fs, base = fs_of(folder)
    fs.create_dir(base, recursive=True)
    passing = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(passing) as out:
        out.write(data)
    if fs.get_file_info(f"{base}/{name}").type.name == "File":
        fs.delete_file(passing)
    else:
        fs.move(passing, f"{base}/{name}")


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, least: int = LEAST, part_contexts: int = PART_CONTEXTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out.alias("held_out"))
    forest = fit(rows.filter(~F.col("held_out")).select("text"), depth, least, part_contexts)
    kind, folder = dict(docs.dtypes)["doc_id"], shared_dir(docs.sparkSession, "postings")
    names = ["run", "ord", "doc_id", "held_out", "n_tokens", "n_bytes", "score", "h", "n_train"]

    def run(batches):
        task, number, docs_in, words_in = TaskContext.get().taskAttemptId() << 20, 0, 0, 0  # an attempt's runs are its own
        held, trains = [], []  # of the run: hash and ordinal of each word; whether each text is learned from
        none = lambda n, k: pa.nulls(n, k)

        def inverted():
            """The rows of a run's words; its postings go to a file."""
            h, o = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")  # ordinals ascend already
            h, o = h[order], o[order]
            pair = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
            tf = np.diff(np.append(pair, len(h)))
            h, o = h[pair], o[pair]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            train = tf * np.concatenate(trains).astype(np.int64)[o]
            n, out = len(first), io.BytesIO()
            np.savez(out, h=h[first], first=np.append(first, len(h)).astype(np.uint32), ords=o, tf=tf.astype(np.min_scalar_type(int(tf.max(initial=0)))))
            _write(folder, f"run-{task + number}.npz", out.getvalue())
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, task + number)), none(n, pa.int32()), none(n, arrow), none(n, pa.bool_()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.float64()), pa.array(h[first].view(np.int64)), pa.array(np.add.reduceat(train, first) if n else train)], names)

        def scored(waiting):
            for (own, total) in zip(waiting, forest.score([w[0] for w in waiting])):
                at, ids, flags, tokens, size = own[1:]
                n = len(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at[0])), pa.array(np.arange(at[1], at[1] + n, dtype=np.int32)), ids, flags, pa.array(tokens), pa.array(size), pa.array(total), none(n, pa.int64()), none(n, pa.int64())], names)

        waiting, waits = [], 0
        for batch in batches:
            arrow = batch.schema.field(0).type
            train = ~np.asarray(batch.column(2).cast(pa.int8())).astype(bool)
            for lo, hi, data, off in pieces(*utf8(batch.column(1)), PIECE, RUN_DOCS):
                n = hi - lo
                if docs_in + n > RUN_DOCS or words_in > RUN_WORDS:
                    yield inverted()
                    number, docs_in, words_in, held, trains = number + 1, 0, 0, [], []
                words = Words(data, off, SPACE_WORDS)
                held.append((words.h, (words.row + docs_in).astype("<u2")))
                trains.append(train[lo:hi])
                tokens, size = np.bincount(words.row, minlength=n) + 1, np.bincount(words.row, words.end - words.start, n).astype(np.int64)
                waiting.append(((*symbols_of(data, off, words, forest.depth), n), (task + number, docs_in), batch.column(0)[lo:hi], batch.column(2)[lo:hi], tokens, size))
                docs_in, words_in, waits = docs_in + n, words_in + len(words.h), waits + len(data)
                if forest.parts == 1 or waits > HELD:
                    yield from scored(waiting)
                    waiting, waits = [], 0
        if waiting:
            yield from scored(waiting)
        if held:
            yield inverted()

    done = table_of(rows.mapInArrow(lean(run, "suffix tree"), f"run long, ord int, doc_id {kind}, held_out boolean, n_tokens long, n_bytes long, score double, h long, n_train long"), "scored")
    words_of = done.filter("h is not null").select("run", "h", "n_train")
    counts = table_of(words_of.groupBy("h").agg(F.sum("n_train").alias("c"), F.count("*").alias("runs")), "words")
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()

    def part(frame: pa.Table) -> pa.Table:
        run = frame["run"][0].as_py()
        fs, base = fs_of(folder)
        with fs.open_input_file(f"{base}/run-{run}.npz") as file, np.load(io.BytesIO(file.read())) as x:
            h, first, ords, tf = x["h"], x["first"].astype(np.int64), x["ords"], x["tf"].astype(float)
        told, c = np.asarray(frame["h"]).view(np.uint64), np.asarray(frame["c"])
        order = np.argsort(told)
        if not np.array_equal(told[order], h):
            raise ValueError(f"run {run} hasn't the words that its rows tell")
        c, size = c[order], np.diff(first)
        base, known = np.bincount(ords, tf * np.repeat(np.log10(c + 1.0), size)), np.bincount(ords, tf * np.repeat(c > 0, size))
        return pa.table({"run": pa.array(np.full(len(base), run)), "ord": pa.array(np.arange(len(base), dtype=np.int32)), "base": pa.array(base), "known": pa.array(known.astype(np.int64))})

    told = join_hot(words_of.select("run", "h"), counts, "h", "runs").select("run", "h", "c")
    base = told.groupBy("run").applyInArrow(part, "run long, ord int, base double, known long")
    texts = done.filter("h is null").select("run", "ord", "doc_id", "held_out", "n_tokens", "n_bytes", "score")
    ends = texts.filter(~F.col("held_out")).count()  # each training text has one end
    tokens = words + ends
    off = float(np.log10(tokens + distinct + (ends > 0) + 1))
    own = (F.coalesce("base", F.lit(0.0)) + float(np.log10(ends + 1)) - F.col("n_tokens") * off).alias("base_score")
    known = (F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("long").alias("n_known")
    return texts.join(base, ["run", "ord"], "left").select("doc_id", "held_out", "n_tokens", known, F.lit(tokens).cast("long").alias("train_tokens"), own, "score", "n_bytes")


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold_of("doc_id", 7) == 2)

"""N-gram Jaccard self-join by T-occurrence search.

Two documents link when the Jaccard similarity of their sets of five-word
shingles is 0.75 or more. Equal sets are one class, searched for once. Then, exactly:

1. A fixed half of all shingles (by hash) is tested for occurring in another
   document. A document that links with another lacks at most a quarter of its
   shingles there; if more of its half are found nowhere else, it is out.
2. Of the documents left, every shingle names its holder with the smallest id,
   its pivot. A document may forget pivots as long as the forgotten shingles
   are fewer than half of those it must share: those that bring it least for
   the size of their group. Two linked documents keep a pivot in common.
   Documents meet in the groups of their pivots.
3. In a group, inverted lists are searched for documents that occur at least T
   times: short lists are merged, long ones only probed by binary search for
   candidates that can still reach T (DivideSkip). Counts are exact, so the
   similarity is. Pairs already connected are not searched again.
4. Groups over ``GROUP`` documents are split by set size into bands and those
   into chunks, each with the pivot. Documents that all these searches together
   could not connect to the pivot are searched for in the chunks of their own
   band and the two beside it: sets further apart in size can't link.

Keys that hold a large part of all rows (exact copies of one text, the pivot
of a large group) are looked up by broadcast, see ``common.look_up``.
Shingles are 64-bit hashes of lower-cased (A-Z) words.

Defined results: null and empty texts and texts of white space have no
shingles and link with nothing; fewer than five words make one shingle;
repeated rows and ties link; rows without an id get no component; rows with
one id are one node, whatever their texts; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaybook.llm.common import BYTE_VALUE, discard, look_up, mix64, stored, text_bytes_total, tidy_group, tidy_map, utf8
from assaybook.llm.components import components
from assaybook.llm.shared_keys import buckets_for, find_shared

SIZE, PERCENT, GROUP = 5, 75, 128
_SLICE = 8 * GROUP  # at most so many documents are searched for in one chunk at once
_CHUNK = 1 << 21
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = BYTE_VALUE[_LOWER]
_BASE = 0x9E3779B97F4A7C55
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and its inverse's, modulo 2**64; those of texts longer than a chunk aren't kept."""
    usual = _CHUNK + (1 << 16)
    if n > usual or not _powers:
        found = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(max(n, usual), base, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps))
        if n > usual:
            return found[0][:n], found[1][:n]
        _powers[:] = found
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in ``data``, and where they begin."""
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[raw] * up[: len(raw)])])
    return mix64((run[end] - run[begin]) * down[begin] + (end - begin).astype(np.uint64)), begin


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= _CHUNK):
            size += len(texts[to]) + 1
            to += 1
        group = texts[at:to]
        words, begin = word_hashes(b" ".join(group))
        firsts = np.cumsum([0] + [len(t) + 1 for t in group])
        bounds = np.searchsorted(begin, firsts)
        h = words.copy()
        if len(words) >= SIZE:
            h = words[: len(words) - SIZE + 1].copy()
            for k in range(1, SIZE):
                h = h * _MULTIPLIER + words[k : len(words) - SIZE + 1 + k]
            h = mix64(h)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= SIZE:
                out.append(np.unique(h[a : b - SIZE + 1]))
            elif b > a:
                x = int(b - a)
                for w in words[a:b].tolist():
                    x = (x * int(_MULTIPLIER) + w) & 0xFFFFFFFFFFFFFFFF
                out.append(mix64(np.array([x ^ 0xA5A5A5A5], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        at = to
    return out


def _set_digest(s: np.ndarray) -> tuple[int, int]:
    mixed = mix64(s ^ np.uint64(0x1234567))
    return int(mixed.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0, int(np.bitwise_xor.reduce(mix64(mixed)).view(np.int64)) if len(s) else 0


def _texts(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a batch's texts, of bounded size, with the row at which each begins."""
    held, size, first = [], 0, 0
    for i, item in enumerate(batch.column(column)):
        held.append(utf8(item.as_py()))
        size += len(held[-1])
        if size >= _CHUNK:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def _in_half(s: np.ndarray) -> np.ndarray:
    return s[s < np.uint64(1 << 63)]


def _in_sample(s: np.ndarray) -> np.ndarray:
    return s[s < np.uint64(3 << 61)]


def _must_share(size, sampled):
    """Of ``sampled`` shingles of a document of ``size``, how many a linked document must hold at least."""
    return sampled - size * (100 - PERCENT) // 100


def described(docs: DataFrame, n_buckets: int) -> DataFrame:
    """``doc_id, n, d1, d2, candidate``: each row's set size and digest, and whether it may link with another set."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in _texts(batch):
                sets = shingle_sets(texts)
                halves = [_in_half(s) for s in sets]
                number = np.repeat(np.arange(len(sets)), [len(s) for s in halves])
                d1, d2 = zip(*map(_set_digest, sets), strict=True)
                columns = (ids[first : first + len(sets)], [len(s) for s in sets], [len(h) for h in halves], d1, d2)
                about = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n", "half", "d1", "d2"])
                yield np.concatenate(halves), number, number, about, len(sets), len(sets)

    def finish(about: pa.Table, refs: np.ndarray) -> pa.Table:
        shared = np.bincount(refs.astype(np.int64), minlength=len(about))
        n, half = np.asarray(about["n"]), np.asarray(about["half"])
        return about.drop_columns(["half"]).append_column("candidate", pa.array((n > 0) & (shared >= _must_share(n, half))))

    return find_shared(docs, gather, n_buckets, finish, "doc_id long, n long, d1 long, d2 long, candidate boolean")


class Union:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def t_occurrence(sets: list[np.ndarray], queries: list[int], union: Union) -> list[tuple[int, int]]:
    """Links that connect what ``union`` has apart: each query against all sets.

    For a query of n shingles T is 75 % of n, rounded up. The L longest of its
    lists are set aside, with L = T / (log2 M / 10 + 1) for a longest list of
    M; a set must occur at least T - L times in the others, which are merged. Only
    such sets are looked up in the long lists, and only while they can reach T.
    """
    sizes = np.array([len(s) for s in sets])
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(inverse, kind="stable")
    lists = owner[order]
    starts = np.searchsorted(inverse[order], np.arange(len(tokens) + 1))
    firsts = np.cumsum(sizes) - sizes
    found = []
    for x in queries:
        n = int(sizes[x])
        own = inverse[firsts[x] : firsts[x] + n]
        lengths = starts[own + 1] - starts[own]
        need = -(-n * PERCENT // 100)
        longest = int(lengths.max(initial=1))
        aside = min(n - 1, int(need / (np.log2(max(2, longest)) / 10 + 1)))
        aside = min(aside, need - 1)
        by_length = own[np.argsort(lengths, kind="stable")]
        short, long_ = by_length[: n - aside], by_length[n - aside :]
        spans = starts[short + 1] - starts[short]
        at = np.repeat(starts[short] - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        count = np.bincount(lists[at], minlength=len(sets))
        root = union.find(x)
        near = np.flatnonzero((count >= need - aside) & (sizes * PERCENT <= n * 100) & (sizes * 100 >= n * PERCENT))
        near = np.array([y for y in near.tolist() if y != x and union.find(y) != root], np.int64)
        have = count[near]
        for k, token in enumerate(long_.tolist()):
            if not len(near):
                break
            one = lists[starts[token] : starts[token + 1]]
            place = np.minimum(np.searchsorted(one, near), len(one) - 1)
            have = have + (one[place] == near)
            alive = have + (aside - k - 1) >= need
            near, have = near[alive], have[alive]
        for y, both in zip(near.tolist(), have.tolist(), strict=True):
            if both * 100 >= PERCENT * (n + int(sizes[y]) - both) and union.join(x, y):
                found.append((x, y))
    return found


def _edges(ids: list[int], pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"u": pa.array([ids[a] for a, _ in pairs], pa.int64()), "v": pa.array([ids[b] for _, b in pairs], pa.int64())})


def _sets_of(table: pa.Table) -> tuple[list[int], list[np.ndarray], Union]:
    """Ids and sets of a group's rows, equal rows once, with the sets of one id joined."""
    seen: dict[tuple[int, bytes], None] = {}
    for i, s in zip(table["doc_id"].to_pylist(), table["shingles"].to_pylist(), strict=True):
        seen.setdefault((i, s))
    ids = [i for i, _ in seen]
    union, first = Union(len(ids)), {}
    for k, i in enumerate(ids):
        union.join(k, first.setdefault(i, k))
    return ids, [np.frombuffer(s, "<u8") for _, s in seen], union


def _search_chunk(table: pa.Table) -> pa.Table:
    """Links inside a chunk (with its pivot); a self-link marks a document left apart from the pivot, in a split group."""
    pivot, split = table["pivot"][0].as_py(), table["split"][0].as_py()
    ids, sets, union = _sets_of(table)
    out = _edges(ids, t_occurrence(sets, list(range(len(ids))), union))
    if split:
        root = union.find(ids.index(pivot))
        out = pa.concat_tables([out, _edges(ids, [(k, k) for k in range(len(ids)) if union.find(k) != root])])
    return out.append_column("pivot", pa.array([pivot] * len(out), pa.int64()))


_CONNECTED, _APART, _ASKS = 0, 1, 2  # a document's part in the search for those left apart


def _search_apart(table: pa.Table) -> pa.Table:
    """Links of the documents that ask with those of a chunk, of which some are connected with the pivot already."""
    part: dict[int, int] = {}
    for i, p in zip(table["doc_id"].to_pylist(), table["part"].to_pylist(), strict=True):
        part[i] = max(p, part.get(i, p))
    ids, sets, union = _sets_of(table)
    at_pivot = [k for k, i in enumerate(ids) if part[i] == _CONNECTED]
    for k in at_pivot[1:]:
        union.join(at_pivot[0], k)
    return _edges(ids, t_occurrence(sets, [k for k, i in enumerate(ids) if part[i] == _ASKS], union))


def _band(size: Column) -> Column:
    """Sets whose similarity can reach the bound differ by one band at most."""
    return F.floor(F.log(size) / math.log(100 / PERCENT) + 1e-9).cast("int")


def _numbers_up_to(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def links(sets: DataFrame) -> DataFrame:
    """``u, v``: links that connect every component, from ``doc_id, shingles`` of distinct sets."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                chosen, may = [], []
                for item in part.column(1):
                    s = np.frombuffer(item.as_buffer(), "<u8")
                    sample = _in_sample(s)
                    must = _must_share(len(s), len(sample))
                    chosen.append(sample if must >= 1 else s)
                    may.append(max(0, (must - 1) // 2))
                n = [len(s) for s in chosen]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen).view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), n)), pa.array(np.repeat(may, n).astype(np.int32))], ["token", "doc_id", "may"])

    rows = sets.select("doc_id", "shingles").mapInArrow(tidy_map(tokens), "token long, doc_id long, may int")
    pivots = rows.groupBy("token").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("holders")).filter("pivot < last").drop("last")
    counted = rows.join(pivots, "token").groupBy("doc_id", "may", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("holders").alias("holders"))
    # first the pivots with the fewest shingles for the size of their group: those within the bound are forgotten
    order = Window.partitionBy("doc_id", "may").orderBy(F.col("n") / (1 + F.col("holders") / GROUP), "pivot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = stored(counted.withColumn("lost", F.sum("n").over(order)).filter("lost > may").select("doc_id", "pivot").distinct(), "jaccard-groups")
    sizes = stored(groups.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "jaccard-sizes")
    member = look_up(groups, sizes.withColumn("split", F.col("n") > GROUP), ["pivot"], "n")
    sized = sets.select("doc_id", (F.octet_length("shingles") / 8).cast("long").alias("size"), "shingles")
    # one band where a group isn't split; there every id is in the group once, with all its sets
    member = stored(member.join(sized.groupBy("doc_id").agg(F.collect_set(_band(F.col("size"))).alias("bands")), "doc_id").select("pivot", "doc_id", "split", F.explode(F.when(F.col("split"), F.col("bands")).otherwise(F.array(F.lit(0)))).alias("band")), "jaccard-members")
    bands = stored(member.groupBy("pivot", "split", "band").agg(F.count(F.lit(1)).alias("n")).withColumn("chunks", F.when(F.col("split"), F.ceil(F.col("n") / GROUP)).otherwise(F.lit(1)).cast("long")), "jaccard-bands")
    dealt = stored(look_up(member, bands, ["pivot", "split", "band"], "n").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))).drop("chunks"), "jaccard-dealt")
    discard(groups, sizes, member)
    # every chunk of a split group has the pivot, too: its sets are sent in copies of which each serves a few chunks
    split = bands.filter("split")
    hosts = stored(split.groupBy("pivot").agg(F.ceil(F.sum("chunks") / 64).cast("long").alias("copies")), "jaccard-hosts")
    pivot_sets = hosts.join(sets.withColumnRenamed("doc_id", "pivot"), "pivot").select("pivot", _numbers_up_to(F.col("copies")).alias("copy"), "shingles")
    in_chunks = split.join(hosts, "pivot").select("pivot", "band", "copies", _numbers_up_to(F.col("chunks")).alias("chunk")).withColumn("copy", F.pmod(F.xxhash64("band", "chunk"), F.col("copies")))
    in_chunks = in_chunks.join(pivot_sets, ["pivot", "copy"]).select("pivot", F.col("pivot").alias("doc_id"), F.lit(True).alias("split"), "band", "chunk", "shingles")
    gathered = dealt.join(sets, "doc_id").select("pivot", "doc_id", "split", "band", "chunk", "shingles").unionByName(in_chunks)
    searched = gathered.groupBy("pivot", "band", "chunk").applyInArrow(tidy_group(_search_chunk), "u long, v long, pivot long")
    searched = stored(searched, "jaccard-links")
    found, apart = searched.filter("u <> v").select("u", "v"), searched.filter("u = v").select("pivot", F.col("u").alias("doc_id")).distinct()
    if apart.isEmpty():
        return found
    # what other groups have connected to the pivot is done; the rest meets all that it may link with
    labels = components(found)
    holders = stored(apart.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).join(labels.select(F.col("node").alias("pivot"), F.col("component").alias("root")), "pivot", "left").withColumn("root", F.coalesce("root", "pivot")), "jaccard-roots")
    left = look_up(apart, holders, ["pivot"], "n").join(labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").filter(F.coalesce("component", "doc_id") != F.col("root")).select("pivot", "doc_id")
    left = stored(left, "jaccard-apart")
    own = dealt.filter("split").join(left, ["pivot", "doc_id"], "left_semi")
    beside = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band")
    reach = own.select("pivot", "doc_id", beside)
    asked = reach.groupBy("pivot", "band").agg(F.count(F.lit(1)).alias("asking")).withColumn("slices", F.ceil(F.col("asking") / _SLICE).cast("long"))
    asked = stored(asked.join(split.select("pivot", "band", "chunks", "n"), ["pivot", "band"]), "jaccard-asked")
    sent = look_up(reach, asked.drop("n"), ["pivot", "band"], "asking").withColumn("slice", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("slices"))).select("pivot", "doc_id", "band", _numbers_up_to(F.col("chunks")).alias("chunk"), "slice", F.lit(_ASKS).alias("part"))
    where = look_up(dealt.filter("split"), asked.select("pivot", "band", "slices", "n"), ["pivot", "band"], "n").join(left.withColumn("part", F.lit(_APART)), ["pivot", "doc_id"], "left")
    where = where.select("pivot", "doc_id", "band", "chunk", _numbers_up_to(F.col("slices")).alias("slice"), F.coalesce("part", F.lit(_CONNECTED)).alias("part"))
    across = sent.unionByName(where).join(sets, "doc_id").groupBy("pivot", "band", "chunk", "slice").applyInArrow(tidy_group(_search_apart), "u long, v long")
    return labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(across)


def _kept_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, shingles`` of the wanted ``doc_id, d1, d2``; repeated rows of one id, which arrive together, once."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple = ()
        for batch in batches:
            for first, texts in _texts(batch):
                own = batch.slice(first, len(texts))
                ids, shingles = [], []
                for i, s, *digest in zip(own.column(0).to_pylist(), shingle_sets(texts), own.column(2).to_pylist(), own.column(3).to_pylist(), strict=True):
                    if _set_digest(s) == tuple(digest) and (i, *digest) != before:
                        before = (i, *digest)
                        ids.append(i)
                        shingles.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shingles, pa.binary())], ["doc_id", "shingles"])

    return docs.join(wanted, "doc_id").select("doc_id", "text", "d1", "d2").mapInArrow(tidy_map(sets), "doc_id long, shingles binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n_buckets = buckets_for(docs.sparkSession, text_bytes_total(texts, "text"))
    about = stored(described(texts, n_buckets), "jaccard-sets")
    linkable = about.filter("n > 0 AND doc_id IS NOT NULL")
    same = ["n", "d1", "d2"]
    classes = stored(linkable.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.bool_or("candidate").alias("candidate")), "jaccard-classes")
    kept = stored(_kept_sets(texts, classes.filter("candidate").select(F.col("least").alias("doc_id"), "d1", "d2")), "jaccard-kept", "doc_id")
    # rows of one id with several texts connect their classes
    several = linkable.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("a"), F.max(F.struct(*same)).alias("z")).filter("a <> z").select("doc_id")
    by_id = linkable.join(several, "doc_id").select("doc_id", *same).distinct().join(classes, same).select(F.col("doc_id").alias("u"), F.col("least").alias("v"))
    found = components(links(kept).unionByName(by_id)).select(F.col("node").alias("least"), "component")
    discard(kept)
    # a class of one row that nothing links with is its own component, and needs no look-up
    named = classes.join(found, "least", "left").select(*same, "copies", F.coalesce("component", "least").alias("component"), (F.col("component").isNotNull() | (F.col("copies") > 1)).alias("told"))
    named = stored(named.filter("told").drop("told"), "jaccard-named")
    discard(classes)
    out = look_up(about, named, same, "copies", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

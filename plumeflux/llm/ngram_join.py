"""N-gram Jaccard join with a prefix tree (operator 4)."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeflux.llm.bloom import likely_hit
from plumeflux.llm.components import connected_components
from plumeflux.llm.text import distinct, mix, shingle_sets
from plumeflux.session import PLACE, cut_lineage, released, released_group, with_places

BLOCK_TOKENS = 4 << 20  # 32 MB of hashes
LOAD_BITS = 26  # counters of token loads: 32 MB of levels, four bits each, at every size of the input
CHUNK_BITS = 16
EDGE_TOKENS = 64


def band_width(percent: int) -> float:
    """Width of a size band in log(size): linked sets lie in one band or in two neighbouring ones (a hair wider than their largest ratio)."""
    return math.log(max(100 / percent, 1.05)) * (1 + 1e-9)


class PackedLevels:
    """Levels of token counters, two in a byte."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.packed[at >> 1] >> ((at & 1) << 2).astype(np.uint8)) & 15


def pair_classes(octave: int, percent: int) -> int:
    """Classes by hash in which prefix tokens are paired, for larger sets of 2**octave tokens or more (below the next octave).

    1.5 times what a set may have beyond the shared part, which gives the fewest pairs; less than linked sets share at least.
    """
    size = 1 << octave
    return min(size * (100 - percent) * 3 // 200, -(-percent * size // 100) - 1)


def prefixes(tokens: np.ndarray, levels: np.ndarray | PackedLevels, percent: int) -> list[tuple[int, int, np.ndarray]]:
    """(octave, classes, rarest tokens) for every octave of the larger set's size in which the set may have a link.

    The global order of tokens is (level, hash). Linked sets share at least ``percent``% of the larger one; the first
    classes + 1 shared tokens come before all other shared ones in both, so they lie in the prefixes of both,
    and two of them lie in one class. A token of level 0 lies in no other set and is left out. A set that can be
    linked with equal ones only has no prefix: equal sets are one class.
    """
    n = len(tokens)
    most = 100 * n // percent
    if (n + most) * (100 - percent) < 100 + percent:
        return []
    level = levels[(tokens >> np.uint64(64 - LOAD_BITS)).astype(np.int64)]
    order = np.argsort(level, kind="stable")
    out = []
    for octave in range(n.bit_length() - 1, most.bit_length()):
        classes = pair_classes(octave, percent)
        first = order[: n + percent * -max(n, 1 << octave) // 100 + classes + 1]
        out.append((octave, classes, tokens[first[level[first] > 0]]))
    return out


def pair_keys(some: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of many prefixes at once, and whose prefix each is of: every two tokens of a class make a key (one token where there are no classes)."""
    size = [len(tokens) for *_, tokens in some]
    owner = np.repeat(np.arange(len(some)), size)
    token = np.concatenate([tokens for *_, tokens in some])
    salt = mix(np.array([octave for octave, *_ in some], np.uint64))
    classes = np.array([c for _, c, _ in some], np.uint64)
    single = classes[owner] == 0
    keys, owners = [mix(token[single] + salt[owner[single]])], [owner[single]]
    code = owner.astype(np.uint64) << np.uint64(32) | ((token & np.uint64(0xFFFFFFFF)) * classes[owner]) >> np.uint64(32)
    order = np.argsort(code[~single], kind="stable")
    token, owner, code = (v[~single][order] for v in (token, owner, code))
    at, apart = np.arange(len(code)), 1
    while len(at := at[: np.searchsorted(at, len(code) - apart)]):
        at = at[code[at] == code[at + apart]]
        keys.append(mix(token[at] + token[at + apart] + salt[owner[at]]))
        owners.append(owner[at])
        apart += 1
    return np.concatenate(keys), np.concatenate(owners)


def prefix_keys(tokens: np.ndarray, levels: np.ndarray | PackedLevels, percent: int) -> np.ndarray:
    """Keys of a set: pairs of its rarest tokens. Two linked sets that are not equal share at least one."""
    some = prefixes(tokens, levels, percent)
    return pair_keys(some)[0] if some else tokens[:0]


class PrefixTree:
    """Sets of ordered tokens; common beginnings share nodes, long edges come in runs of ``EDGE_TOKENS``.

    A node knows the least and the largest size of the sets below it, so a probe leaves a subtree as soon
    as the overlap so far plus all that can still match would not reach the similarity.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.nodes: list[tuple[np.ndarray, int, int, int, list[int], list[int]]] = []  # tokens, depth after, sizes, children, ends
        self.root = self._build(order, 0)

    def _build(self, order: list[int], depth: int) -> int:
        root = len(self.nodes)
        self.nodes.append(None)
        work = [(root, order, depth, depth)]
        while work:
            place, members, start, depth = work.pop()
            first, last = self.sets[members[0]], self.sets[members[-1]]
            room = min(len(first), len(last), start + EDGE_TOKENS)
            differ = np.flatnonzero(first[depth:room] != last[depth:room])
            end = depth + int(differ[0]) if len(differ) else room
            sizes = [len(self.sets[k]) for k in members]
            ends = [k for k in members if len(self.sets[k]) == end]
            rest = [k for k in members if len(self.sets[k]) > end]
            children = []
            at = 0
            while at < len(rest):
                token, stop = self.sets[rest[at]][end], at + 1
                while stop < len(rest) and self.sets[rest[stop]][end] == token:
                    stop += 1
                children.append(len(self.nodes))
                self.nodes.append(None)
                work.append((children[-1], rest[at:stop], end, end))
                at = stop
            self.nodes[place] = (first[start:end], end, min(sizes), max(sizes), children, ends)
        return root

    def _settled(self, component: np.ndarray) -> np.ndarray:
        """Per node a set below it if all sets below it are in one component, else -1."""
        out = np.full(len(self.nodes), -1, np.int64)
        for place in range(len(self.nodes) - 1, -1, -1):  # children come after their parent
            *_, children, ends = self.nodes[place]
            below = [*ends, *(out[c] for c in children)]
            if min(below) >= 0 and len({component[k] for k in below}) == 1:
                out[place] = below[0]
        return out

    def join(self, probes: list[np.ndarray], percent: int, cells: int = 8_000_000, component: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Pairs (set, linked probes). All probes walk the tree together, a batch at a time: a node's tokens
        are looked up once for the probes still alive, and a probe dies where its bound fails.

        With ``component`` (of the sets, then of the probes; only of the sets where they are the probes), kept
        up to date by the caller, a probe also leaves a subtree whose sets are all in its own component.
        """
        universe = distinct(np.concatenate([*self.sets, *probes]))
        rank = [np.searchsorted(universe, node[0]) for node in self.nodes]
        step, at, done = max(1, cells // len(universe)), 0, 0
        mine = None if component is None else component[len(component) - len(probes) :]
        while at < len(probes):
            if component is not None and done & (done - 1) == 0:
                settled = self._settled(component)
            done += 1
            end = at + (step if component is None or at else min(step, 16))
            batch = probes[at:end]
            n = np.array([len(x) for x in batch])
            has = np.zeros((len(batch), len(universe)), np.uint8)
            for k, x in enumerate(batch):
                has[k, np.searchsorted(universe, x)] = 1
            upto = np.cumsum(has, axis=1, dtype=np.int32)
            stack = [(self.root, np.arange(len(batch)), np.zeros(len(batch), np.int64))]
            while stack:
                place, alive, overlap = stack.pop()
                if component is not None and settled[place] >= 0:
                    apart = mine[at + alive] != component[settled[place]]
                    alive, overlap = alive[apart], overlap[apart]
                    if len(alive) == 0:
                        continue
                _, depth, least, most, children, ends = self.nodes[place]
                tokens, passed = rank[place], 0
                if len(tokens):
                    overlap = overlap + has[np.ix_(alive, tokens)].sum(1, dtype=np.int64)
                    passed = upto[alive, tokens[-1]]
                own = n[alive]
                # of the sizes below, the one that suits best: all that is left of the probe matched, nothing more
                size = np.clip(depth + own - passed, least, most)
                good = (100 + percent) * (overlap + np.minimum(own - passed, size - depth)) >= percent * (own + size)
                alive, overlap = alive[good], overlap[good]
                if len(alive) == 0:
                    continue
                for k in ends:
                    yield k, at + alive[(100 + percent) * overlap >= percent * (n[alive] + depth)]
                stack.extend((c, alive, overlap) for c in children)
            at = end


def spanning_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links among ``left`` (``right`` None), or of ``right`` (numbered after ``left``) to ``left``, that join new components."""
    shift = 0 if right is None else len(left)
    component = np.arange(len(left) + (0 if right is None else len(right)))
    out = []
    for k, found in PrefixTree(left).join(left if right is None else right, percent, component=component):
        found = found + shift
        while True:
            new = found[component[found] != component[k]]
            if len(new) == 0:
                break
            out.append((k, int(new[0])))
            component[component == component[new[0]]] = component[k]
    return out


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _new_sets(batch: pa.RecordBatch, width: int, said: set[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """Digest and tokens of each set of the first column that this task has not said; one said twice does no harm."""
    for tokens in shingle_sets(batch.column(0), width):
        digest = _digest(tokens)
        if len(tokens) and digest not in said:
            if len(said) < 200_000:  # bounds memory
                said.add(digest)
            yield digest, tokens


def set_classes(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per row: key, n_shingles, class (digest of its set; null without shingles), text_hash, columns to ``keep``. One scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for tokens in shingle_sets(batch.column(1), width):
                sizes.append(len(tokens))
                digests.append(_digest(tokens) if len(tokens) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_shingles", "class", "text_hash", *keep])

    kind = docs.schema[key].dataType.simpleString()
    kept = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(F.col(key), F.col(text), F.xxhash64(text), *keep).mapInArrow(released(run), f"`{key}` {kind}, n_shingles bigint, class binary, text_hash bigint{kept}")


def token_levels(docs: DataFrame, width: int, text: str = "text") -> PackedLevels:
    """Level of every token counter: 0 if one set at most has its tokens, then rising with the logarithm of its load.

    A counter (the first ``LOAD_BITS`` bits of a token) sums the sets of all its tokens over all rows; equal
    sets count once per task. Tasks send chunks of counters, a sum per chunk is streamed, and the driver
    gets four bits per counter (rounds of doubling): 32 MB at every size of the input. With far more different tokens than counters
    levels tell only frequent tokens from the rest; results stay the same, clusters grow.
    """
    chunks = 1 << (LOAD_BITS - CHUNK_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        load, said = np.zeros(1 << LOAD_BITS, np.uint8), set()
        for batch in batches:
            for _, tokens in _new_sets(batch, width, said):
                at = (tokens >> np.uint64(64 - LOAD_BITS)).astype(np.int64)
                more = np.diff(np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])))  # tokens are sorted
                at = distinct(at)
                load[at] = np.minimum(load[at] + more, 255)  # a task's share of a counter stops there
        load = load.reshape(chunks, -1)
        used = np.flatnonzero(load.any(axis=1))
        packed = [zlib.compress(np.packbits(load[k] > 0).tobytes() + load[k][load[k] > 0].tobytes(), 1) for k in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "load"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, bitmap = zlib.decompress(packed.as_py()), 1 << (CHUNK_BITS - 3)
                have = np.unpackbits(np.frombuffer(raw[:bitmap], np.uint8)).astype(bool)
                sums.setdefault(chunk, np.zeros(1 << CHUNK_BITS, np.uint32))[have] += np.frombuffer(raw[bitmap:], np.uint8)
        levels = [np.minimum(15, np.ceil(np.log2(np.maximum(s, 1)))).astype(np.uint8) for s in sums.values()]
        levels = [(s[::2] | (s[1::2] << 4)).tobytes() for s in levels]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["chunk", "level"])

    loads = docs.select(F.col(text)).mapInArrow(released(count), "chunk int, load binary")
    out = np.zeros((chunks, 1 << (CHUNK_BITS - 1)), np.uint8)
    levels = cut_lineage(loads.repartition(64, "chunk").mapInArrow(released(total), "chunk int, level binary"))
    for row in levels.coalesce(4).toLocalIterator():  # a quarter at a time
        out[row["chunk"]] = np.frombuffer(row["level"], np.uint8)
    return PackedLevels(out.reshape(-1))


def class_keys(docs: DataFrame, levels, width: int, percent: int, text: str = "text", flush: int = 1_000_000) -> DataFrame:
    """Rows (seg, c, m): prefix keys of every set; c is the first half of its class digest. ``levels`` is a broadcast.

    A task ties classes that meet in the keys of ``flush`` prefix tokens to their smallest one by itself (seg null, m the
    smallest) and sends only that one on (m null), so a key that very many sets share is small before the shuffle.
    """

    def rows(held: list[tuple[int, int, np.ndarray]], owners: list[int]) -> Iterator[pa.RecordBatch]:
        key, of = pair_keys(held)
        if len(key) == 0:
            return
        key, owner = key.view(np.int64), np.array(owners, np.int64)[of]
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        lead = np.concatenate([[True], key[1:] != key[:-1]])
        least = owner[lead][np.cumsum(lead) - 1]
        tied = np.unique(np.stack([owner, least])[:, owner != least], axis=1)
        none = np.zeros(lead.sum(), np.int64), np.zeros(tied.shape[1], np.int64)
        for seg, c, m in ((pa.array(key[lead]), owner[lead], pa.array(none[0], mask=np.ones(len(none[0]), bool))), (pa.array(none[1], mask=np.ones(len(none[1]), bool)), tied[0], pa.array(tied[1]))):
            yield pa.RecordBatch.from_arrays([seg, pa.array(c), m], names=["seg", "c", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said: set[bytes] = set()
        held, owners, n = [], [], 0
        for batch in batches:
            for digest, tokens in _new_sets(batch, width, said):
                own = prefixes(tokens, levels.value, percent)
                held += own
                owners += [int.from_bytes(digest[:8], "big", signed=True)] * len(own)
                n += sum(len(rare) for *_, rare in own)
                if n > flush:
                    yield from rows(held, owners)
                    held, owners, n = [], [], 0
        if n:
            yield from rows(held, owners)

    return docs.select(F.col(text)).mapInArrow(released(run), "seg bigint, c bigint, m bigint")


def _join_blocks(width: int, percent: int):
    """Blocks of the clusters of a bin: each with itself, or with another block of its cluster."""

    def run(table: pa.Table) -> pa.Table:
        parts: dict[tuple, dict[bytes, np.ndarray]] = {}  # copies of a set are dropped here
        texts = (t for chunk in table["text"].chunks for t in shingle_sets(chunk, width))
        for root, i, j, side, tokens in zip(*(table[c].to_pylist() for c in ("root", "i", "j", "side")), texts):
            parts.setdefault((root, i, j, side), {})[_digest(tokens)] = tokens
        a, b = [], []
        for (root, i, j, side), own in sorted(parts.items()):
            other = parts.get((root, i, j, 1), {})
            if side:
                continue
            names = [*sorted(own), *sorted(other)]
            sets = [own.get(d, other.get(d)) for d in names]
            for x, y in spanning_links(sets[: len(own)], sets[len(own) :] or None, percent):
                a.append(names[x])
                b.append(names[y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def jaccard_links(docs: DataFrame, classes: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Links (a, b) between classes that connect every two linked classes, by prefix-tree joins.

    1. Sets that share two tokens of one class of their prefixes (the rarest tokens, see ``prefixes``) are candidates; a
       passage that many documents share is not rare, and one token that sets share by chance, of which a large corpus
       has many, ties nothing. Each key's classes are tied to its smallest one, and components of these ties are the clusters.
    2. One text of every clustered class goes to its cluster (texts move, being smaller than their sets).
       Small clusters share a task. Clusters of more than ``block_tokens`` tokens are cut by size band, and
       bands in blocks of about that many tokens; one tree is built for each pair of blocks of a band or of
       neighbouring bands, and probed. Only links that join new components leave a task.
    """
    levels = docs.sparkSession.sparkContext.broadcast(token_levels(docs, width, text))
    keys = class_keys(docs, levels, width, percent, text)
    tie = F.coalesce("m", F.min("c").over(Window.partitionBy("seg", "m")))  # keys move once and are not written
    clusters = cut_lineage(connected_components(keys.select(F.col("c").alias("a"), tie.alias("b"))))
    levels.destroy()

    half = F.conv(F.hex(F.substring("class", 1, 8)), 16, -10).cast("bigint")
    members = classes.where(F.col("class").isNotNull()).withColumn("c", half).join(clusters, F.col("c") == F.col("node"))
    one = F.min(F.struct(key, "text_hash"))
    chosen = cut_lineage(members.groupBy("class").agg(one.alias("one"), F.first("root").alias("root"), F.max("n_shingles").alias("n")))
    total = chosen.groupBy("root").agg(F.sum("n").alias("tokens"))
    bins = 1 + (total.agg(F.sum("tokens")).first()[0] or 0) * 2 // block_tokens
    own = F.when(F.col("tokens") <= block_tokens, F.lit(0)).otherwise(F.floor(F.log("n") / band_width(percent))).cast("bigint")
    banded = cut_lineage(chosen.join(total, "root").withColumn("band", own))
    size = banded.groupBy("root", "band").agg(F.ceil(F.sum("n") / F.lit(block_tokens)).alias("blocks"))
    in_order = Window.partitionBy("root").orderBy("band")
    near = [F.when(f(F.col("band")).over(in_order) == F.col("band") + d, f(F.col("blocks")).over(in_order)).otherwise(0) for f, d in ((F.lag, -1), (F.lead, 1))]
    size = size.withColumn("before", near[0]).withColumn("after", near[1])
    # a block's number: band * 2**20 + place in the band
    def numbers(blocks: str, d: int) -> Column:
        first = (F.col("band") + d) * (1 << 20)
        return F.when(F.col(blocks) > 0, F.sequence(first, first + F.col(blocks) - 1)).otherwise(F.array().cast("array<bigint>"))

    each = [numbers("before", -1), numbers("blocks", 0), numbers("after", 1)]
    block = F.col("band") * (1 << 20) + F.pmod(F.xxhash64("class"), F.col("blocks"))
    home = banded.join(size, ["root", "band"]).select("root", (F.col("tokens") <= block_tokens).alias("single"), block.alias("block"), F.concat(*each).alias("others"), F.col(f"one.{key}").alias("__id"), F.col("one.text_hash").alias("__hash"))
    hit = likely_hit(home.select("__hash"), banded.count(), F.xxhash64(F.xxhash64(text)))  # other texts do not move
    texts = docs.where(hit).select(F.col(key).alias("__key"), F.col(text).alias("text"), F.xxhash64(text).alias("__of"))
    texts = texts.join(home, texts["__key"].eqNullSafe(home["__id"]) & (texts["__of"] == home["__hash"]))
    pairs = F.transform("others", lambda o: F.struct(F.least(F.col("block"), o).alias("i"), F.greatest(F.col("block"), o).alias("j"), (F.col("block") > o).cast("int").alias("side")))
    dealt = texts.withColumn("__pair", F.explode(pairs)).select("root", "single", "__pair.i", "__pair.j", "__pair.side", "text")
    dealt = dealt.withColumn("place", F.when(F.col("single"), F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root", "i", "j")))
    return dealt.groupBy("single", "place").applyInArrow(released_group(_join_blocks(width, percent)), "a binary, b binary")


def ngram_components(docs: DataFrame, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links).

    A set holds the distinct ``width``-word shingles of the whole text as 64-bit hashes; with fewer words
    the whole sequence is one shingle; without words the set is empty and linked with nothing. Two rows
    link when their sets' Jaccard similarity is at least ``percent`` / 100. Rows with equal sets are one
    class and pass as one. Null keys take part and get the smallest key of their component, null if
    there is none; repeated rows keep rows of their own.
    """
    classes = cut_lineage(set_classes(docs, width, key, text))
    links = connected_components(jaccard_links(docs, classes, width, percent, key, text, block_tokens))
    least = classes.where(F.col("class").isNotNull()).groupBy("class").agg(F.min(key).alias("__least"))
    named = least.join(links, F.col("class") == F.col("node"), "left").withColumn("__root", F.coalesce("root", "class"))
    roots = named.groupBy("__root").agg(F.min("__least").alias("__smallest"), F.count(F.lit(1)).alias("__n"))
    # classes without links keep their own smallest key
    moved = named.join(roots.where("__n > 1"), "__root").select("class", "__smallest")
    ids = least.join(moved, "class", "left").select("class", F.coalesce("__smallest", "__least").alias("component_id"))
    out = classes.join(ids, "class", "left")
    return out.select(key, "n_shingles", F.coalesce("component_id", F.col(key)).alias("component_id"))


def keep_representatives(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` with one row of every group of near duplicates: the first by key (null last), hash of the text and place.

    What goes is told by its place, so rows with null or repeated keys go or stay by their own text. Rows
    without words stay. Columns travel as one struct, so their names clash with nothing; an empty table
    gives no rows.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc")
    placed = with_places(docs, key, text, whole)
    classes = cut_lineage(set_classes(placed, width, key, text, PLACE))
    links = connected_components(jaccard_links(docs, classes, width, percent, key, text, block_tokens))
    sets = classes.where(F.col("class").isNotNull())
    named = sets.join(links, F.col("class") == F.col("node"), "left").withColumn("__root", F.coalesce("root", "class"))
    order = F.struct(F.col(key).isNull(), key, "text_hash", *PLACE)
    groups = named.groupBy("__root").agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    others = named.join(groups, "__root").where(~order.eqNullSafe(F.col("__first")))
    return placed.join(others.select(*PLACE), list(PLACE), "left_anti").select("__doc.*")

"""Line dedup by a segment-partition edit join (operator 2), with built-in functions only."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeflux.llm.bloom import likely_hit
from plumeflux.llm.components import connected_components
from plumeflux.llm.license_scan import let
from plumeflux.session import cut_lineage

MAX_EDITS = 2
MIN_CHARS = 16
BAG = "abcdefghijklmnopqrstuvwxyz ,."
PAIRED = 32  # lines of a group that are paired at once; larger groups are split
MAX_SPLIT_EDITS = 2  # with more edits the ways to halve windows make the expression too large to compile


def split_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 0), line: the parts of every text between newlines, empty ones too. Null text: one empty line."""
    return docs.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))


def segment_keys(line: Column, n: Column, edits: int) -> Column:
    """Hashes by which lines within ``edits`` meet: array of (key, indexed).

    A line is cut into edits + 1 segments; of two lines within the distance one segment of the shorter
    stands unchanged in the longer. Each line is indexed by its own segments, and probes those of lines
    0 to ``edits`` characters shorter: at every start that a match whose left part and right part keep
    within their shares of the edits allows (so the number of probes does not depend on the length).
    Keys hold the indexed length, the segment's number and its characters.
    """
    parts = edits + 1
    out = []
    for shorter in range(edits + 1):
        length = n - shorter
        base, extra = F.floor(length / parts).cast("int"), F.pmod(length, F.lit(parts)).cast("int")
        for i in range(parts):
            # the last ``extra`` segments are one character longer
            size = base + F.when(extra >= parts - i, 1).otherwise(0)
            start = base * i + F.greatest(F.lit(0), extra - (parts - i))
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            for shift in range(low, high + 1):
                key = F.xxhash64(length, F.lit(i), F.substring(line, start + shift + 1, size))
                out.append(F.struct(key.alias("key"), F.lit(shorter == 0 and shift == 0).alias("indexed")))
    return F.array(*out)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings is at most ``edits`` (up to 10), by a banded bit-parallel automaton.

    Bit d of level e says that the first j characters of ``b`` and the first j + d - edits of ``a`` are
    within e edits. One step of ``b`` moves all diagonals of the band of a level at once by shifts and
    masks; levels sit side by side in one 64-bit word each.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    n, m = F.char_length(a), F.char_length(b)

    def reach(levels: list[Column]) -> list[Column]:
        """Skipping characters of ``a`` costs an edit each."""
        out = [levels[0]]
        for e in range(1, edits + 1):
            out.append(levels[e].bitwiseOR(F.shiftleft(out[e - 1], 1).bitwiseAND(F.lit(full))))
        return out

    start = [sum(1 << (edits + d) for d in range(e + 1)) for e in range(edits + 1)]
    zero = F.array(*[F.lit(v) for v in start])

    def step(chars: Column, state: Column, j: Column) -> Column:
        match = F.lit(0)
        for d in range(width):
            at = j + (d - edits)
            same = (at >= 1) & (at <= n) & (F.get(chars["a"], at - 1) == F.get(chars["b"], j - 1))
            match = match.bitwiseOR(F.when(same, F.lit(1 << d)).otherwise(F.lit(0)))
        levels = [state[0].bitwiseAND(match)]
        for e in range(1, edits + 1):
            # same diagonal with a match, a replaced character, or a character of b too many
            levels.append(state[e].bitwiseAND(match).bitwiseOR(state[e - 1]).bitwiseOR(F.shiftright(state[e - 1], 1)))
        return F.array(*reach(levels))

    both = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    last = let(both, lambda chars: F.aggregate(F.sequence(F.lit(1), m), zero, lambda state, j: step(chars, state, j)))
    end = n - m + edits
    reached = F.pmod(F.floor(last[edits] / F.pow(F.lit(2.0), end)), F.lit(2)) == 1
    return F.when(F.abs(n - m) > edits, F.lit(False)).when(m == 0, n <= edits).otherwise(reached)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning, by halving steps that each compare one part."""
    most = F.least(F.char_length(a), F.char_length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])

    def grow(have: Column, step: Column) -> Column:
        more = (have + step <= most) & (F.substring(a, have + 1, step) == F.substring(b, have + 1, step))
        return F.when(more, have + step).otherwise(have)

    return F.aggregate(steps, F.lit(0), grow)


def trimmed(a: Column, b: Column) -> Column:
    """Struct of both strings without common beginning and end, which never take an edit."""
    cut = let(common_prefix(a, b), lambda n: F.struct(F.substring(a, n + 1, F.char_length(a)).alias("a"), F.substring(b, n + 1, F.char_length(b)).alias("b")))
    drop = lambda x, n: F.substring(x, F.lit(1), F.char_length(x) - n)

    def tail(s: Column) -> Column:
        n = common_prefix(F.reverse(s["a"]), F.reverse(s["b"]))
        return let(n, lambda k: F.struct(drop(s["a"], k).alias("a"), drop(s["b"], k).alias("b")))

    return let(cut, tail)


def letter_counts(line: Column) -> Column:
    """How often each letter of BAG occurs; an edit changes two of the counts by one, at most."""
    return F.array(*[F.char_length(line) - F.char_length(F.translate(line, c, "")) for c in BAG])


def character_marks(line: Column, edits: int) -> Column:
    """Hashes of which two lines within ``edits`` share at least one: array of 2 * edits + 1 marks.

    Characters fall into that many classes by code point, so that letters of any script spread evenly,
    and a mark tells how often each character of one class occurs (the sum of their hashes). An
    edit touches two classes at most, a replacement's old and new character, so ``edits`` of them leave one class as it was.
    """
    classes = 2 * edits + 1
    none = F.lit(0).cast("bigint")
    codes = F.transform(F.split(line, ""), lambda c: F.struct(F.pmod(F.ascii(c), F.lit(classes)).alias("g"), F.shiftrightunsigned(F.xxhash64(c), 33).alias("h")))

    def mark(codes: Column, g: int) -> Column:
        total = F.aggregate(codes, none, lambda s, c: s + F.when(c["g"] == g, c["h"]).otherwise(none))
        return F.xxhash64(F.lit(g), total)

    return let(codes, lambda h: F.array(*[mark(h, g) for g in range(classes)]))


def sharing(entries: DataFrame, key: str) -> DataFrame:
    """Rows (h1, key, indexed) whose key at least two lines have, one of them as its own segment.

    Keys are counted map-side and joined back, so a key of very many lines is split like any skewed join.
    """
    met = entries.groupBy(key).agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("indexed").alias("any"))
    return entries.join(met.where("lo <> hi AND any").select(key), key, "left_semi").select("h1", key, "indexed")


def narrowed_pairs(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates (a < b) among lines that share a segment (h1, key, indexed): some mark of theirs agrees too."""
    finer = shared.join(texts.select("h1", "marks"), "h1").withColumn("mark", F.explode("marks"))
    finer = cut_lineage(sharing(finer.select("h1", F.xxhash64("key", "mark").alias("key"), "indexed"), "key"))
    x, y = finer.where("indexed").select(F.col("h1").alias("a"), "key"), finer.select(F.col("h1").alias("b"), "key")
    return x.join(y, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def split_window(line: Column, edits: int, start: Column, n: Column, moved: Column) -> list[tuple]:
    """Ways in which two lines differ by exactly ``edits`` in a window, by the halves that hold the edits.

    The window has ``n`` characters in the indexed line; in this line it begins at ``start`` and has
    ``moved`` more. Each way: edits in the first half, characters that stand unchanged, windows left
    (edits, start, n, moved), whether the halves keep their sizes, whether this line allows it. A window
    of one character stays as it is.
    """
    half = F.shiftright(n, 1)
    out = [
        (0, F.substring(line, start + 1, half), [(edits, start + half, n - half, moved)], True, n - half + moved >= 0),
        (edits, F.substring(line, start + half + moved + 1, n - half), [(edits, start, half, moved)], True, (n > 1) & (half + moved >= 0)),
    ]
    for left in range(1, edits):
        for d in range(-left, left + 1):
            rest = moved - d
            fits = (n > 1) & (F.abs(rest) <= edits - left) & (half + d >= 0) & (n - half + rest >= 0)
            out.append((left, F.lit(""), [(left, start, half, F.lit(d)), (edits - left, start + half + d, n - half, rest)], d == 0, fits))
    return out


def edit_forms(edits: int) -> list[tuple[int, ...]]:
    """Every way to deal 1 to ``edits`` edits to windows in a row, one at least to each."""
    return [(total,) for total in range(1, edits + 1)] + [(k, *rest) for k in range(1, edits) for rest in edit_forms(edits - k)]


def split_groups(lines: DataFrame, edits: int) -> DataFrame:
    """Candidates (a < b) among lines (h1, line) of large groups, without pairing whole groups.

    Lines whose lengths allow a match start as one group, with the whole line as window and an exact
    number of edits in it. Round by round every window is halved and lines stay together that agree in the halves
    without edits, so a pair within ``edits`` goes one way through the rounds. A group of at most PAIRED rows
    is paired, a larger one is halved on; windows of one character end it, when nearly all pairs are links.
    A group is dropped when all its lines agree in some window: its pairs have fewer edits and are met there.
    """
    forms = edit_forms(edits)

    def state(gid: Column, indexed: Column, line: Column, windows: list[tuple]) -> Column:
        w = F.array(*[F.struct(s.alias("s"), n.alias("n"), d.alias("d")) for _, s, n, d in windows])
        own = [F.xxhash64(F.substring(line, s + 1, n + d)) for _, s, n, d in windows]
        # lines differ in every window; those that a form lacks are filled up by the line itself
        own += [F.col("h1")] * (edits - len(own))
        form = F.lit(forms.index(tuple(e for e, *_ in windows)))
        more = F.greatest(F.lit(1), *[n for _, _, n, _ in windows]) > 1
        return F.struct(gid.alias("gid"), indexed.alias("indexed"), form.alias("form"), w.alias("w"), more.alias("more"), *[c.alias(f"own{i}") for i, c in enumerate(own)])

    def halved(form: tuple[int, ...]) -> Column:
        """States after a round of a state of one form."""
        line, out = F.col("line"), []
        ways = [split_window(line, e, *[F.col("w")[i][c] for c in "snd"]) for i, e in enumerate(form)]
        for way in product(*ways):
            name = F.lit(",".join(str(x[0]) for x in way))
            gid = F.xxhash64("gid", F.lit(str(form)), name, *[x[1] for x in way])
            fits, still = F.lit(True), F.lit(all(x[3] for x in way))
            for x in way:
                fits = fits & x[4]
            out.append(F.when(fits, state(gid, F.col("indexed") & still, line, [w for x in way for w in x[2]])))
        return F.array(*out)

    size, zero = F.char_length("line"), F.lit(0)
    first = [state(F.xxhash64(F.lit(e), size - d), F.lit(d == 0), F.col("line"), [(e, zero, size - d, F.lit(d))]) for e in range(1, edits + 1) for d in range(e + 1)]
    states = lines.select("h1", F.explode(F.array(*first)).alias("k")).select("h1", "k.*")
    owns = [f"own{i}" for i in range(edits)]
    found = []
    while True:
        after = F
        for k, form in enumerate(forms):
            after = after.when(F.col("form") == k, halved(form))
        split = states.select("h1", "gid", "indexed", "form", "w").join(lines, "h1").select("h1", F.explode(after).alias("k"))
        split = cut_lineage(split.where("k IS NOT NULL").select("h1", "k.*"))
        sizes = split.groupBy("gid").agg(F.count(F.lit(1)).alias("rows"), F.max("indexed").alias("any"), *[f(c).alias(f"{f.__name__}_{c}") for c in owns for f in (F.min, F.max)])
        met = sizes.where("any").where(" AND ".join(f"min_{c} <> max_{c}" for c in owns))
        now = cut_lineage(split.join(met.select("gid", "rows"), "gid").withColumn("again", F.col("more") & (F.col("rows") > PAIRED)))
        found.append(now.where(~F.col("again")).select("gid", "h1", "indexed", *owns))
        states = now.where("again")
        if states.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    x = every.where("indexed").select("gid", F.col("h1").alias("a"), *[F.col(c).alias(f"x_{c}") for c in owns])
    y = every.select("gid", F.col("h1").alias("b"), F.col("indexed").alias("both"), *owns)
    # of two indexed lines the smaller one meets the other
    once = (F.col("a") < F.col("b")) | ((F.col("a") != F.col("b")) & ~F.col("both"))
    for c in owns:
        once = once & (F.col(f"x_{c}") != F.col(c))
    return x.join(y, "gid").where(once).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def line_links(docs: DataFrame, lines: DataFrame, edits: int, min_chars: int, key: str, text: str) -> DataFrame:
    """Linked pairs (a, b) of different lines, a and b structs of the lines' two hashes, each pair once.

    Lines that share a segment are narrowed by ``character_marks`` before they are paired. Where more
    than PAIRED lines share one they are paired by ``split_groups`` instead (up to MAX_SPLIT_EDITS edits),
    so that many lines with one segment in common but other differences do not all meet each other.
    """
    long_lines = lines.where(F.col("n") >= min_chars)
    # equal lines are one line from here on
    one = long_lines.groupBy("h1", "h2").agg(F.first("keys").alias("keys"))
    entries = one.select("h1", F.explode("keys").alias("k")).select("h1", "k.key", "k.indexed")
    group = Window.partitionBy("key")
    shared = entries.withColumn("lo", F.min("h1").over(group)).withColumn("hi", F.max("h1").over(group)).withColumn("any", F.max("indexed").over(group))
    shared = shared.withColumn("many", (F.count(F.lit(1)).over(group) > PAIRED) & F.lit(0 < edits <= MAX_SPLIT_EDITS))
    shared = cut_lineage(shared.where((F.col("lo") != F.col("hi")) & F.col("any")).select("h1", "key", "indexed", "many"))

    # texts of candidate lines only: a Bloom filter spares the others the shuffle, the join is exact
    wanted = cut_lineage(shared.select("h1").distinct())
    h1, h2 = F.xxhash64("line"), F.xxhash64("line", F.lit(1))
    again = split_lines(docs, key, text).select("line", h1.alias("h1"), h2.alias("h2"))
    again = again.where(likely_hit(wanted, wanted.count(), F.xxhash64("h1")))
    texts = again.groupBy("h1", "h2").agg(F.first("line").alias("line")).join(wanted, "h1")
    texts = cut_lineage(texts.withColumn("bag", letter_counts(F.col("line"))).withColumn("marks", character_marks(F.col("line"), edits)))

    pairs = narrowed_pairs(shared.where("NOT many").drop("many"), texts)
    crowd = shared.where("many").select("h1").distinct()
    if not crowd.isEmpty():
        pairs = pairs.unionByName(split_groups(cut_lineage(texts.join(crowd, "h1", "left_semi").select("h1", "line")), edits)).distinct()
    left = texts.select(F.col("h1").alias("a"), F.struct("h1", "h2").alias("na"), F.col("line").alias("la"), F.col("bag").alias("sa"))
    right = texts.select(F.col("h1").alias("b"), F.struct("h1", "h2").alias("nb"), F.col("line").alias("lb"), F.col("bag").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    # cheap bounds first: lengths, then letter counts
    moved = sum((F.abs(F.col("sa")[k] - F.col("sb")[k]) for k in range(len(BAG))), F.lit(0))
    near = both.where(F.abs(F.char_length("la") - F.char_length("lb")) <= edits).where(moved <= 2 * edits)
    left_over = near.select("na", "nb", trimmed(F.col("la"), F.col("lb")).alias("t"))
    hit = let(F.col("t"), lambda t: within(t["a"], t["b"], edits))
    found = left_over.select("na", "nb", hit.alias("hit")).where("hit")
    return cut_lineage(found.select(F.col("na").alias("a"), F.col("nb").alias("b")))


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per line of every text: key, line_no, n_chars, class_id, class_line, links, kept.

    Lines of at least ``min_chars`` characters link when their edit distance (characters) is at most
    ``edits``; equal lines of any length are one class, so are lines that links connect. ``class_id``
    and ``class_line`` name the first line of the class (smallest key, then line_no; null keys come
    first), the one that is ``kept``; ``links`` counts the different lines linked directly. Repeated
    rows have equal keys and line numbers, so all of them are kept or none. Lines are identified by 128
    bits of hash. Null and empty texts are one empty line; an empty table gives no rows; a
    very long line is compared whole, after the beginning and end it shares with its candidate are cut;
    other columns are not read.
    """
    rows = split_lines(docs, key, text)
    n = F.char_length("line")
    h1, h2 = F.xxhash64("line"), F.xxhash64("line", F.lit(1))
    slim = rows.select(F.col(key), "line_no", n.alias("n_chars"), h1.alias("h1"), h2.alias("h2"))
    keyed = rows.where(n >= min_chars).select(n.alias("n"), h1.alias("h1"), h2.alias("h2"), segment_keys(F.col("line"), n, edits).alias("keys"))
    links = line_links(docs, keyed, edits, min_chars, key, text)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    roots = connected_components(links)
    place = F.struct(F.col(key).alias("id"), F.col("line_no").alias("line"))
    firsts = slim.groupBy("h1", "h2").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n"))
    named = firsts.join(roots, F.struct("h1", "h2") == F.col("node")).join(degree, F.col("node") == F.col("a"))
    heads = named.groupBy("root").agg(F.min("at").alias("head"))
    linked = named.join(heads, "root").select("h1", "h2", "head", "links")
    repeated = firsts.join(linked, ["h1", "h2"], "left").where(F.col("head").isNotNull() | (F.col("n") > 1))
    known = repeated.select("h1", "h2", F.coalesce("head", "at").alias("head"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
    out = slim.join(known, ["h1", "h2"], "left")
    own = F.coalesce("head", place)
    kept = own["id"].eqNullSafe(F.col(key)) & (own["line"] == F.col("line_no"))
    return out.select(key, "line_no", "n_chars", own["id"].alias("class_id"), own["line"].alias("class_line"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), kept.alias("kept"))

"""Similarity joins: shingle overlap, cosine, nearest neighbours, semantic search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.text import shingle_hashes
from tessera.functions.vectors import norm
from tessera.operators.blocks import spans, stream_past, tiles
from tessera.operators.components import connected_components
from tessera.operators.skew import join_per_key
from tessera.session import cut


#: A set member that this many sets or fewer have in their prefixes gives all their pairs; beyond it, pairs are made by rounds of anchors.
#: Members of a hot one that one unit of such a round takes.
FEW, UNIT = 64, 4_096


def _alike(rows: DataFrame, within: list[str], same: list[str]) -> tuple[DataFrame, DataFrame]:
    """(k, i): the smallest key of each group of rows (k) equal in `within` and `same`, numbered; and (rep, k): the others with that key."""
    first = rows.groupBy(*within, *same).agg(F.min("k").alias("rep"), F.count("*").alias("w"))
    first = cut(first.withColumn("i", F.monotonically_increasing_id()))
    several, member = first.where("w > 1").drop("i"), rows
    for c in within:  # nulls are equal here
        several, member = several.withColumn(c, F.to_json(F.struct(c))), member.withColumn(c, F.to_json(F.struct(c)))
    copies = cut(join_per_key(member, several, [*within, *same], "w").where("k <> rep").select("rep", "k"))
    return first.select(F.col("rep").alias("k"), "i"), copies


def _shingle_sets(docs: DataFrame, key: str, text: str, k: int, within: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(i, within, s): shingle sets as distinct 64-bit hashes (two shingles of one pair of texts would collide about once in 10**14 pairs), one for equal texts; (k, i): their keys; (rep, k): keys of equal texts."""
    rows = docs.select(F.col(key).alias("k"), *within, F.col(text).alias("t"))
    keys, copies = _alike(rows.select("k", *within, F.xxhash64("t").alias("g1"), F.xxhash64(F.lit(1), "t").alias("g2")), within, ["g1", "g2"])
    # dealt out by key first: making sets is the heavy part, and a few large input splits would leave most cores idle
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "k").join(keys, "k").select("i", *within, shingle_hashes("t", k).alias("s")), keys, copies


def _shared_members(sets: DataFrame, at_least: float, within: list[str]) -> DataFrame:
    """(i, n, r, places): the size of each set and its members that other sets have too, rarest first; sets that have too few of these go.

    With sets ordered by how rare a member is, two sets of similarity s share one
    of their first n - ceil(s * n) + 1 members, so only those are joined. Members
    that occur once are the rarest and can't be shared, so they take up prefix
    places first, and the first `places` of the others are left. A member counts
    within its group of rows equal in `within`. It is counted where its rows are
    sorted; as no set has it twice, it is one row of each set at most.
    """
    x = F.xxhash64(*within, "x") if within else F.col("x")
    items = sets.select("i", F.size("s").alias("n"), F.explode("s").alias("x"), *within).select("i", "n", x.alias("x"))
    shared = items.withColumn("df", F.count("*").over(Window.partitionBy("x"))).where("df > 1")
    ranked = shared.groupBy("i", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("r"))
    places = F.size("r") - F.ceil(F.lit(at_least) * F.col("n")).cast("int") + 1
    return cut(ranked.select("i", "n", F.col("r.x").alias("r"), places.alias("places")).where("places > 0"))


def _prefixes(shared: DataFrame) -> DataFrame:
    """(i, n, x, before): the members x that each set is joined by, and the one before it."""
    at = F.posexplode(F.slice("r", F.lit(1), F.col("places"))).alias("pos", "x")
    return shared.select("i", "n", "r", at).select("i", "n", "x", F.get("r", F.col("pos") - 1).alias("before"))


def _side(prefix: DataFrame, c: str, *more) -> DataFrame:
    return prefix.select(F.col("i").alias(c), F.col("n").alias(f"n{c}"), F.col("before").alias(f"before_{c}"), "x", *more)


def _meeting(prefix: DataFrame, at_least: float) -> DataFrame:
    """(a, b) with a < b of sets that share a prefix member.

    Near copies share long runs of members: where the members before are the
    same too, the pair comes up there, so it does not here. The first member that
    two prefixes share has no such one before it.
    """
    met = (F.col("a") < F.col("b")) & ~F.coalesce(F.col("before_a") == F.col("before_b"), F.lit(False)) & _near_sizes(at_least, "na", "nb")
    return _side(prefix, "a").join(_side(prefix, "b"), "x").where(met).select("a", "b").distinct()


def _verified(pairs: DataFrame, shared: DataFrame, at_least: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose whole sets overlap enough; what they have in common is among their shared members."""
    of = lambda side: shared.select(F.col("i").alias(side), F.col("n").alias(f"n{side}"), F.col("r").alias(f"r{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", F.size(F.array_intersect("ra", "rb")).alias("c"))
    return both.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard")).where(F.col("jaccard") >= at_least)


def _near_sizes(at_least: float, n: str, m: str):
    return (F.col(n) >= F.lit(at_least) * F.col(m)) & (F.col(m) >= F.lit(at_least) * F.col(n))


def shingle_pairs(docs: DataFrame, key: str, text: str, at_least: float, k: int = 4, within: list[str] | None = None) -> DataFrame:
    """(a, b, jaccard) of all rows with a < b whose shingle sets overlap enough; keys are unique within `within`.

    Equal texts are compared once, and their pairs written out at the end. All
    pairs of a group of copies are among the result: for groups of copies alone,
    near_copies gives the same components with links in proportion to rows.
    """
    within = within or []
    named = docs.select(F.struct(*within, F.col(key).alias("key")).alias("k"), F.col(text).alias("t"), *within)
    sets, of_rep, copies = _shingle_sets(named, "k", "t", k, within)
    shared = _shared_members(sets, at_least, within)
    found = _verified(_meeting(_prefixes(shared), at_least), shared, at_least)
    more = copies.join(of_rep.withColumnRenamed("k", "rep"), "rep").select("i", "k")
    member = lambda df, c: df.select(F.col("i").alias(c), F.col("k").alias(f"k{c}"))
    every = of_rep.select("i", "k").union(more)
    unlike = found.join(member(every, "a"), "a").join(member(every, "b"), "b").select("ka", "kb", "jaccard")
    alike = copies.select(F.col("rep").alias("ka"), F.col("k").alias("kb")).union(member(more, "a").join(member(more, "b"), F.col("a") == F.col("b")).where("ka < kb").select("ka", "kb"))
    pairs = unlike.union(alike.withColumn("jaccard", F.lit(1.0))).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "jaccard")
    return pairs.select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), *[F.col(f"a.{c}").alias(c) for c in within], "jaccard")


def near_copies(docs: DataFrame, key: str, text: str, at_least: float, k: int = 4, within: list[str] | None = None) -> DataFrame:
    """(node, component) of the keys of rows that have a row within reach by links of texts whose shingle sets overlap enough.

    Keys are unique; a component is named by its smallest key. Only rows equal in
    the columns `within` are linked. See near_sets.
    """
    return _near(*_shingle_sets(docs, key, text, k, within or []), at_least, within or [])


def near_sets(sets: DataFrame, at_least: float, within: list[str] | None = None) -> DataFrame:
    """(node, component) of sets (k, within, s: sorted longs) linked by an overlap of at_least, never making all pairs of copies; equal sets are one, by two 64-bit hashes of the whole."""
    within = within or []
    whole = sets.select("k", *within, F.xxhash64("s").alias("g1"), F.xxhash64(F.lit(1), "s").alias("g2"), F.size("s").alias("n"))
    keys, copies = _alike(whole, within, ["n", "g1", "g2"])
    return _near(sets.join(keys, "k").select("i", *within, "s"), keys, copies, at_least, within)


def _near(sets: DataFrame, keys: DataFrame, copies: DataFrame, at_least: float, within: list[str]) -> DataFrame:
    """(node, component) of the keys of sets (i, within, s) and of their copies.

    Members of few
    prefixes give their pairs at once. A member of more than FEW prefixes gives
    them in rounds: its sets are ordered by a hash of their number, and a round pairs
    its next anchors (twice as many as in the round before) with the sets that
    come after them in other components so far. A group of copies becomes one
    component with its first anchor that is like the others, so later rounds have
    nothing left of it, while sets that are not alike are all compared. Rows of
    a hot member are dealt out UNIT by UNIT, so no task holds all of them. Up to
    the end sets go by their numbers, so keys are not shuffled.
    """
    shared = _shared_members(sets, at_least, within)
    prefix = cut(_prefixes(shared).withColumn("m", F.count("*").over(Window.partitionBy("x"))).where("m > 1"))
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = cut(_verified(_meeting(prefix.where(F.col("m") <= FEW), at_least), shared, at_least).select("a", "b"), fresh=True)
    most = prefix.agg(F.max("m")).first()[0] or 0
    if most > FEW:
        parts = cut(connected_components(links))
        hot = cut(prefix.where(F.col("m") > FEW).withColumn("place", F.pmod(F.xxhash64("i"), "m")))
        subs = F.ceil(F.col("m") / UNIT).cast("int")
        low, wide = 0, FEW
        while low < most:
            now = hot.where(F.col("place") >= low).join(parts.withColumnRenamed("node", "i"), "i", "left").withColumn("c", F.coalesce("component", "i"))
            anchors = _side(now.where(F.col("place") < low + wide), "a", F.col("place").alias("pa"), F.col("c").alias("ca"), F.explode(F.sequence(F.lit(0), subs - 1)).alias("sub"))
            others = _side(now, "b", F.col("place").alias("pb"), F.col("c").alias("cb"), F.pmod(F.xxhash64("i", F.lit(1)), subs).cast("int").alias("sub"))
            after = (F.col("pa") < F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("a") < F.col("b")))
            pairs = ordered(anchors.join(others, ["x", "sub"]).where(after & (F.col("ca") != F.col("cb")) & _near_sizes(at_least, "na", "nb")))
            found = cut(_verified(pairs, shared, at_least).select("a", "b"))
            if not found.isEmpty():
                links = cut(links.union(found), fresh=True)
                parts = cut(connected_components(links))
            low, wide = low + wide, 2 * wide
    key = lambda c: keys.select(F.col("i").alias(c), F.col("k").alias(f"k{c}"))
    named = links.join(key("a"), "a").join(key("b"), "b").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    return connected_components(named.union(copies.select(F.col("rep").alias("a"), F.col("k").alias("b"))))


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v): vectors as doubles of length 1; zero vectors are left out, as they are similar to nothing."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    return df.select(F.col(key).alias("k"), v.alias("v"), norm(v).alias("n")).where("n > 0").select("k", F.transform("v", lambda x: x / F.col("n")).alias("v"))


#: Rows of a block at most, about; rows of a block that are multiplied at once; vectors that one task may group; hits that a task holds before it thins them out.
BLOCK_ROWS, TILE, GROUP_ROWS, HELD = 16_384, 512, 8_192, 1 << 22
#: Mean similarities of groups count as equal if they are so to this many digits, whatever order they were summed in.
DIGITS = 12


def _hits(df: DataFrame, blocks: int, at_least: float, thin=None, within: list[str] | None = None) -> DataFrame:
    """(a, b, sim) with a < b: pairs of rows (k, v) whose product is at_least or more, unit by unit.

    Rows are dealt to blocks by hash and every pair of blocks is one unit; its
    products are made in tiles of TILE rows. Each pair of rows comes up in one
    unit, once. thin(a, b, sim, rank) gives the hits of a unit to go on with (a
    and b are places of rows, rank their keys' order). within: only rows equal
    in these columns meet. A column w divides v (the size of what v sums up).
    """
    import numpy as np
    import pyarrow as pa

    within = within or []
    weighted = "w" in df.columns
    kind = dict(df.dtypes)["k"]

    def product(table: pa.Table) -> pa.Table:
        k = np.array(table["k"].to_pylist(), dtype=object)
        rank = np.unique(k, return_inverse=True)[1]
        home, i, j = (table[c].to_numpy() for c in ("home", "i", "j"))
        m = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(k), -1)
        if weighted:
            m = m / table["w"].to_numpy()[:, None]
        left, right = np.flatnonzero(home == i[0]), np.flatnonzero(home == j[0])
        other, found, held = m[right].T, [(left[:0], left[:0], np.empty(0))], 0
        gather = lambda: [np.concatenate(x) for x in zip(*found)]
        for tile in (left[x : x + TILE] for x in range(0, len(left), TILE)):
            at, to = np.nonzero(m[tile] @ other >= at_least - 1e-9)
            at, to = tile[at], right[to]
            once = (rank[at] != rank[to]) & ((i[0] != j[0]) | (at < to))
            at, to = at[once], to[once]
            at, to = np.where(rank[at] < rank[to], at, to), np.where(rank[at] < rank[to], to, at)
            sim = np.einsum("ij,ij->i", m[at], m[to])
            found.append(tuple(x[sim >= at_least] for x in (at, to, sim)))
            held += len(found[-1][0])
            if thin and held >= HELD:
                found, held = [thin(*gather(), rank)], 0
        a, b, sim = gather()
        if thin:
            a, b, sim = thin(a, b, sim, rank)
        return pa.table({"a": pa.array(k[a].tolist(), table["k"].type), "b": pa.array(k[b].tolist(), table["k"].type), "sim": sim})

    home = F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")
    dealt = df.withColumn("home", home).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    units = dealt.select(*df.columns, "home", F.least("home", "o").alias("i"), F.greatest("home", "o").alias("j"))
    return units.groupBy(*within, "i", "j").applyInArrow(product, f"a {kind}, b {kind}, sim double")


def _n_blocks(df: DataFrame) -> int:
    """Blocks of about BLOCK_ROWS rows, eight at least."""
    return max(8, -(-df.count() // BLOCK_ROWS))


def _nearest(n: int, smallest: bool):
    """Thins hits out to those that are among the n nearest of one of their rows; ties go to the larger key, or (smallest) to the smallest pair of keys."""
    import numpy as np

    def thin(a, b, sim, rank):
        if smallest:
            sim = np.round(sim, DIGITS)
        keep, hit = np.zeros(len(a), bool), np.concatenate([np.arange(len(a))] * 2)
        one, two = rank[np.concatenate([a, b])], rank[np.concatenate([b, a])]
        tie = (np.maximum(one, two), np.minimum(one, two)) if smallest else (-two,)
        order = np.lexsort((*tie, -sim[hit], one))
        start = np.flatnonzero(np.diff(one[order], prepend=-1))
        nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
        keep[hit[order[nth < n]]] = True
        return a[keep], b[keep], sim[keep]

    return thin


def _stars(a, b, sim, rank):
    """Thins hits out to stars that join the same rows: minima are handed on until they stay."""
    import numpy as np

    label = np.arange(len(rank))
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (to := label[label]).tolist() != label.tolist():
            label = to
    hung = np.flatnonzero(label != np.arange(len(rank)))
    return label[hung], hung, np.ones(len(hung))


def cosine_pairs(df: DataFrame, key: str, vector: str, at_least: float, blocks: int | None = None) -> DataFrame:
    """(a, b, sim) with a < b and cosine at least `at_least`: all pairs, in blocks of a fixed number of rows.

    The work is that of all pairs, and each row is copied once a block.
    """
    return _hits(unit_vectors(df, key, vector), blocks or _n_blocks(df), at_least)


def nearest_pairs(df: DataFrame, key: str, vector: str, k: int = 10, at_least: float = 0.5, blocks: int | None = None) -> DataFrame:
    """Unordered pairs in which one row is among the k nearest of the other, above at_least; ties go to the larger key.

    A unit passes on the k nearest of its rows only, so what is shuffled grows with rows and blocks, not with pairs.
    """
    pairs = _hits(unit_vectors(df, key, vector), blocks or _n_blocks(df), at_least, _nearest(k, smallest=False))
    both = pairs.select("a", "b", "sim").union(pairs.select("b", "a", "sim"))
    near = both.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), F.desc("b")))).where(F.col("nth") <= k)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def average_linkage(sums, sizes, threshold: float) -> list[int]:
    """Group labels (lowest row of each group) of rows that stand for `sizes` unit vectors with the given sums.

    Rows are in the order of their keys. The mean cosine of two groups is the
    product of their sums over the product of their sizes, so no matrix of pairs
    is held: a chain of nearest neighbours is followed until its last two are
    nearest to each other, and these merge. Of equally near groups (to DIGITS)
    the pair with the smallest lower row, then the smallest other row, comes
    first; a group counts as its lowest row. As a merged group is never nearer to
    a third than both of its parts were, and its row is one of theirs, this gives
    the groups of merging the first of the best pairs at every step, ties
    included. A row whose nearest is too far is done for good.
    """
    import numpy as np

    sums, sizes = np.array(sums, float), np.array(sizes, float)
    up, live, chain = np.arange(len(sums)), np.ones(len(sums), bool), []
    for start in range(len(sums)):
        while live[start]:
            chain = chain or [start]
            top = chain[-1]
            mean = np.where(live, np.round(sums @ sums[top] / (sizes * sizes[top]), DIGITS), -np.inf)
            mean[top] = -np.inf
            near = int(np.argmax(mean))  # the first of the best
            if mean[near] < threshold:
                live[chain.pop()] = False
            elif near not in chain[-2:-1]:
                chain.append(near)
            else:
                keep, gone = sorted((top, near))
                sums[keep] += sums[gone]
                sizes[keep] += sizes[gone]
                up[gone], live[gone] = keep, False
                del chain[-2:]
    for x in range(len(up)):
        up[x] = up[up[x]]
    return up.tolist()


def _merge_mutual(state: DataFrame, threshold: float) -> DataFrame:
    """(x, gone) of all pairs of groups that are nearest to each other within their component, x being the smaller; ties as in average_linkage."""
    hits = _hits(state, _n_blocks(state), threshold - 10.0**-DIGITS, _nearest(1, smallest=True), ["component"]).where(F.col("sim") >= threshold)
    ends = hits.select(F.inline(F.array(*[F.struct(F.col(c).alias("k"), (-F.col("sim")).alias("s"), F.col("a").alias("x"), F.col("b").alias("y")) for c in "ab"])))
    best = ends.groupBy("k").agg(F.min(F.struct("s", "x", "y")).alias("m")).groupBy("m.x", "m.y").agg(F.count("*").alias("n"))
    return best.where("n = 2").select("x", F.col("y").alias("gone"))


def group_by_similarity(df: DataFrame, key: str, vector: str, threshold: float, blocks: int | None = None) -> DataFrame:
    """(key, group): average-linkage groups; group is the smallest key in it.

    Equal vectors are one row with a weight. Groups never cross components of the
    graph of pairs at or above the threshold (a merge needs a mean at least as
    high), so each component is grouped alone: by rounds of mutual merges while
    it has more than GROUP_ROWS groups, then in one task, whose memory is that of
    its vectors. If there are no more than GROUP_ROWS different vectors, one task
    takes them all. Both ways merge the same pairs, with average_linkage's rule for
    ties, so the groups are the same at any size of a component and any GROUP_ROWS.
    """
    import pyarrow as pa

    kind = dict(df.select(key).dtypes)[key]
    units = unit_vectors(df, key, vector)
    alike = cut(units.groupBy("v").agg(F.min("k").alias("k"), F.count("*").cast("double").alias("w")))
    state = alike.select("k", F.transform("v", lambda x: x * F.col("w")).alias("v"), "w")
    few = alike.count() <= GROUP_ROWS
    if few:
        state = state.withColumn("component", F.lit(None).cast(kind))
    else:
        part = connected_components(_hits(alike.select("k", "v"), blocks or _n_blocks(alike), threshold - 1e-9, _stars))
        state = cut(state.join(part, F.col("k") == F.col("node")).drop("node"), fresh=True)
    named = state.select(F.col("k").alias("rep"), "k")
    while not few:
        big = state.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("component")
        if big.isEmpty():
            break
        large, rest = state.join(big, "component", "left_semi"), state.join(big, "component", "left_anti")
        merged = cut(_merge_mutual(large.select("k", "v", "w", "component"), threshold), fresh=True)
        moved = cut(large.join(merged.select("gone", "x"), F.col("k") == F.col("gone"), "left").select(F.coalesce("x", "k").alias("k"), "v", "w", "component", F.col("x").isNotNull().alias("joins")))
        # components in which nothing merges any more are done; in the others two vectors at most become one
        still = moved.where("joins").select("component").distinct()
        add = lambda a, b: F.when(F.size(a) == 0, b).otherwise(F.zip_with(a, b, lambda x, y: x + y))
        one = F.aggregate(F.collect_list("v"), F.array().cast("array<double>"), add).alias("v")
        summed = moved.join(still, "component", "left_semi").groupBy("component", "k").agg(one, F.sum("w").alias("w"))
        state = cut(rest.select("k", "v", "w", "component").unionByName(summed.select("k", "v", "w", "component")), fresh=True)
        named = cut(named.join(merged, F.col("k") == F.col("gone"), "left").select("rep", F.coalesce("x", "k").alias("k")), fresh=True)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        v = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        labels = average_linkage(v, table["w"].to_numpy(), threshold)
        return pa.table({"k": table["k"], "g": table["k"].take(pa.array(labels))})

    grouped = state.select("component", "k", "v", "w").groupBy("component").applyInArrow(merge, f"k {kind}, g {kind}")
    named = named.join(grouped, "k", "left").select("rep", F.coalesce("g", "k").alias("g"))
    member = units.join(alike.select(F.col("k").alias("rep"), "v"), "v").select("k", "rep").join(named, "rep", "left").select("k", F.coalesce("g", "rep").alias("g"))
    return df.select(F.col(key).alias("k")).join(member, "k", "left").select(F.col("k").alias(key), F.coalesce("g", "k").alias("group"))


def semantic_search(stories: DataFrame, query: Column, least: float = 0.08) -> DataFrame:
    """Stories by the best word overlap of the query with their fact or any claim."""
    from tessera.functions.vectors import jaccard

    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda t: F.length(t) > 2))
    parts = stories.select("id", F.explode(F.concat(F.array("fact"), "claims")).alias("part"))
    return parts.groupBy("id").agg(F.max(jaccard(words(F.col("part")), words(query))).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "id")


#: Words and rows of a block of queries; rows of a slice of stories, and slices at least; words of a block counted by products; counts held at once.
QUERY_WORDS, QUERY_ROWS, SLICE_ROWS, SLICES, HOT_WORDS, CELLS = 1 << 23, 1 << 16, 1 << 16, 16, 256, 1 << 20


class _QueryBlock:
    """An inverted index of a block of queries: rows by word; the words of most queries are columns of a matrix instead."""

    def __init__(self, ids, words, sizes) -> None:
        import numpy as np

        self.ids, self.sizes = ids, sizes
        order = np.argsort(words, kind="stable")
        self.rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.words, self.start, self.count = np.unique(words[order], return_index=True, return_counts=True)
        hot = np.argsort(-self.count, kind="stable")[:HOT_WORDS]
        self.column = np.full(len(self.words), -1)
        self.column[hot] = np.arange(len(hot))
        self.hot = np.zeros((len(hot), len(sizes)), np.float32)
        for x, w in enumerate(hot):
            self.hot[x, self.rows[self.start[w] : self.start[w] + self.count[w]]] = 1

    def counts(self, words, sizes):
        """How many words each set (given one after the other) shares with each query."""
        import numpy as np

        of = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        of, at = of[known], at[known]
        is_hot = self.column[at] >= 0
        sets = np.zeros((len(sizes), len(self.hot)), np.float32)
        sets[of[is_hot], self.column[at[is_hot]]] = 1
        of, at = of[~is_hot], at[~is_hot]
        n = self.count[at]
        cells = np.repeat(of * len(self.sizes), n) + self.rows[spans(self.start[at], n)]
        rare = np.bincount(cells, minlength=len(sizes) * len(self.sizes)).reshape(len(sizes), -1)
        return rare + (sets @ self.hot).astype(np.int64)


def search_many(stories: DataFrame, queries: DataFrame, least: float = 0.08, query_words: int = QUERY_WORDS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(q_id, id, score): semantic_search for many queries (q_id, text) at once; stories has (id, fact, claims); a row for each pair of a query's and a story's row.

    The work is that of all pairs, but what is shuffled is not: a block of queries
    is an inverted index in a task, stories stream past it (stream_past), and what
    they share with the queries is counted there. Words are 64-bit hashes.
    """
    import numpy as np
    import pyarrow as pa

    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda t: F.length(t) > 2))
    hashes = lambda c: F.transform(words(c), lambda t: F.xxhash64(t))
    asked = cut(queries.select("q_id", hashes(F.col("text")).alias("w")))
    n_words, n_rows = asked.agg(F.sum(F.size("w")), F.count("*")).first()
    blocks = max(1, -(-(n_words or 0) // query_words), -(-n_rows // query_rows))
    slices = max(SLICES, -(-stories.count() // SLICE_ROWS))
    q_kind, kind = dict(queries.dtypes)["q_id"], dict(stories.dtypes)["id"]
    held = asked.select(F.pmod(F.xxhash64("q_id"), F.lit(blocks)).alias("block"), "q_id", "w")
    sets = stories.select(F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice"), "id", F.transform(F.concat(F.array("fact"), "claims"), hashes).alias("sets")).where(F.size("sets") > 0)

    def build(t: pa.Table):
        w = t["w"].chunk(0)
        return _QueryBlock(t["q_id"].chunk(0), w.flatten().to_numpy(), w.value_lengths().to_numpy()) if len(w.flatten()) else None

    def found(block: _QueryBlock, batch: pa.RecordBatch):
        ids, lists = batch.column("id"), batch.column("sets")
        each_set = lists.flatten()
        parts, sizes, members = lists.value_lengths().to_numpy(), each_set.value_lengths().to_numpy(), each_set.flatten().to_numpy()
        first, at = np.append(0, np.cumsum(parts)), np.append(0, np.cumsum(sizes))
        for x, y in tiles(first, CELLS // len(block.sizes)):
            s, e = first[x], first[y]
            c = block.counts(members[at[s] : at[e]], sizes[s:e])
            of = sizes[s:e, None] + block.sizes[None, :] - c
            i, j = np.nonzero((c > 0) & (c >= (least - 1e-9) * of))
            score = c[i, j] / of[i, j]
            i, j, score = i[score >= least], j[score >= least], score[score >= least]
            i = np.repeat(np.arange(x, y), parts[x:y])[i]
            if e - s > y - x:  # the best set of a row counts
                order = np.lexsort((-score, j, i))
                i, j, score = i[order], j[order], score[order]
                best = (np.diff(i, prepend=-1) != 0) | (np.diff(j, prepend=-1) != 0)
                i, j, score = i[best], j[best], score[best]
            if len(i):
                yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(j)), ids.take(pa.array(i)), pa.array(score)], names=["q_id", "id", "score"])

    return stream_past(held, sets, blocks, slices, build, found, f"q_id {q_kind}, id {kind}, score double")


def cached_embeddings(texts: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with the vectors that the cache has, distinct texts that it lacks) by hash of the text."""
    keyed = texts.withColumn("text_hash", F.sha2(text, 256))
    found = keyed.join(cache.select("text_hash", "vector"), "text_hash", "left")
    missing = keyed.join(cache.select("text_hash"), "text_hash", "left_anti").select("text_hash", text).dropDuplicates(["text_hash"])
    return found, missing

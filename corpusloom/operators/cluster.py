"""Near-duplicate clustering by shingle and attribute sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import jaccard, normalized_tokens
from ..sources.storage import discarded, written
from .components import connected_components
from .set_blocks import class_links, in_blocks, packed_sets
from .shingle_sets import able_sets, described_sets, set_documents


def with_shingles(rows: DataFrame, text: str, name: str = "s", width: int = 5) -> DataFrame:
    """rows with an array of the distinct hashes of `width` consecutive lower-case words of a text, none for fewer words.

    The words are a column of their own on the way, as an expression that uses them several times would split the text as often.
    """
    split = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+"), "")
    rows, words = rows.withColumn("_words", split), F.col("_words")
    n = F.size(words) - (width - 1)
    # Shifted slices side by side: linear in the words, where slicing a window at each of them is not.
    zipped = F.arrays_zip(*[F.slice(words, k + 1, F.greatest(n, F.lit(0))).alias(f"w{k}") for k in range(width)])
    found = F.when(n > 0, F.array_distinct(F.transform(zipped, lambda z: F.xxhash64(z)))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn(name, found).drop("_words")


#: Sets of one block that meet those of another in one task.
SHARE = 4096


def meeting(rows: DataFrame, ratio: float, share: int = SHARE) -> DataFrame:
    """a, b (a < b), each once: keys of rows (t, key, n) that share a t, where the lesser n may be `ratio` of the larger one or more.

    Rows meet by t and by class of n: classes are so wide that what is alike enough is of one class or of two that follow each other, and a row visits the
    class above its own. A block with more rows than `share` is split into sub-blocks by a hash of the key, and each
    two of these are a block of their own, so that no block is left out and none holds more than about share rows of either side, however
    often a t occurs. Rows of such a block go out once for each sub-block. rows must be a written table, as they are read
    three times; where they have a column asked, pairs without a row that is are left out; a key may stand in several rows of a t, which changes nothing; null keys and sizes under 1 meet none.
    """
    width = math.log(1 / ratio) * (1 + 1e-9) if ratio < 1 else math.log(2)
    sized = rows.where("key is not null and n >= 1").select("t", "key", "n", (F.col("asked") if "asked" in rows.columns else F.lit(True)).alias("asked"), F.floor(F.log("n") / width).alias("g"))
    placed = sized.select("t", "key", "n", "asked", F.inline(F.array(F.struct("g", F.lit(True).alias("native")), F.struct((F.col("g") + 1).alias("g"), F.lit(False).alias("native")))))
    # A block whose rows are all of one set, or all visitors, gives no pair.
    blocks = placed.groupBy("t", "g").agg(F.count("*").alias("size"), F.count_if("native").alias("natives"), F.count_if("asked").alias("asked")).where("size > 1 and natives > 0 and asked > 0")
    split = placed.join(blocks.select("t", "g", F.ceil(F.col("size") / share).cast("int").alias("k")), ["t", "g"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("k")).cast("int"))
    others = F.sequence(F.when(F.col("native"), F.col("own")).otherwise(0), F.col("k") - 1)
    left = split.select("t", "g", F.col("key").alias("x"), F.col("n").alias("nx"), F.col("native").alias("home"), F.col("asked").alias("ax"), F.col("own").alias("i"), F.explode(others).alias("j"))
    right = split.where("native").select("t", "g", F.col("key").alias("y"), F.col("n").alias("ny"), F.col("asked").alias("ay"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    once = ~F.col("home") | (F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))
    fits = F.least("nx", "ny") >= F.greatest("nx", "ny") * (ratio - 1e-9)
    met = left.join(right, ["t", "g", "i", "j"]).where((F.col("x") != F.col("y")) & (F.col("ax") | F.col("ay")) & once & fits)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_pairs(texts: DataFrame, key: str, text: str, width: int = 5, percent: int = 75, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): key (a long), its class (the least key with the same shingles) and its number of shingles n; and a, b, common, union for classes at least
    percent alike. Pairs of the texts themselves are listed_pairs() of same_and_near().

    Sets without enough elements that others have too are ruled out by packed counts (described_sets()), so that a row for each shingle is made for the rest alone. Their
    pairs are found by a prefix filter: two sets alike enough share one of the rarest (100 - percent)% or so of
    either's shingles, so that only these are joined. One that is frequent all the same is split into blocks of `share` sets (meeting()).
    """
    described, _ = described_sets(texts.select(F.col(key).alias("doc_id"), F.lower(text).alias("text")), width, percent, lower=False, short=False)
    sets = written(set_documents(described).where("n_shingles > 0").select(F.col("doc_id").alias("key"), "set_id", F.col("n_shingles").cast("int").alias("n")), "set-keys")
    classes = written(sets.groupBy("set_id").agg(F.min("key").alias("class")), "shingle-classes")
    members = sets.join(classes, "set_id").select("key", "class", "n")
    # A set is a class's, and goes by its least key.
    able = able_sets(described).join(classes.where("class is not null").withColumnRenamed("class", "key"), "set_id")
    whole = written(able.select("key", F.size("s").alias("n"), "s"), "able-sets")
    discarded(described)
    terms = whole.select("key", "n", F.explode("s").alias("t"))
    rarity = terms.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    order = Window.partitionBy("key").orderBy("df", "t")
    # Shingles of one set alone come before all others in this order and can't be shared: they use up the prefix.
    shared = terms.join(rarity, "t").withColumn("place", F.row_number().over(order)).withColumn("shared", F.count("*").over(Window.partitionBy("key")))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("shared"))
    rare = written(shared.where(F.col("place") <= prefix).select("t", "key", "n"), "rare-shingles")
    candidates = meeting(rare, percent / 100, share)
    s = whole.select("key", "s")
    both = candidates.join(s.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(s.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("both"))
    pairs = sized.select("a", "b", "common", (F.col("both") - F.col("common")).alias("union")).where(F.col("common") * 100 >= F.col("union") * percent)
    return members, pairs


def same_and_near(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of classes that near_pairs() gives, and each class of several keys with itself (a = b)."""
    several = members.where("key is not null").groupBy("class").agg(F.count("*").alias("size"), F.first("n").alias("n")).where("size > 1")
    return pairs.unionByName(several.select(F.col("class").alias("a"), F.col("class").alias("b"), F.col("n").alias("common"), F.col("n").alias("union")))


#: Keys of a class in one row while pairs of classes become pairs of keys.
LISTED = 1024


def listed_pairs(members: DataFrame, pairs: DataFrame, share: int = LISTED) -> DataFrame:
    """a, b (a < b) and what else pairs has, for all keys of members (key, class) whose classes pairs (a, b) name; those with a = b are of keys of one class.

    Classes are split into rows of about `share` keys, and each two of these that are paired are a row that is dealt to any task and becomes its pairs there, so that
    what is shuffled is the classes and not the pairs of their keys, which grow with the square of a class.
    """
    keyed = members.where("key is not null").select("key", "class").distinct()
    sizes = keyed.groupBy("class").agg(F.ceil(F.count("*") / share).cast("int").alias("k"))
    part = F.pmod(F.xxhash64("key"), F.col("k")).cast("int")
    rows = written(keyed.join(sizes, "class").groupBy("class", part.alias("part")).agg(F.collect_list("key").alias("keys")), "class-keys")
    side = lambda c: rows.select(F.col("class").alias(c), F.col("part").alias(f"_i_{c}"), F.col("keys").alias(f"_keys_{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").where("a < b or _i_a <= _i_b")
    spark = members.sparkSession
    dealt = met.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    others = [c for c in pairs.columns if c not in ("a", "b")]
    both = dealt.select(((F.col("a") == F.col("b")) & (F.col("_i_a") == F.col("_i_b"))).alias("_own"), *others, "_keys_b", F.explode("_keys_a").alias("_x"))
    each = both.select("_own", "_x", *others, F.explode("_keys_b").alias("_y")).where("not _own or _x < _y")
    return each.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), *others)


def near_clusters(texts: DataFrame, key: str, text: str, width: int = 5, percent: int = 75, share: int = SHARE) -> DataFrame:
    """key, cluster (its least key), size and place for each member of a cluster of two or more."""
    members, pairs = near_pairs(texts, key, text, width, percent, share)
    component = connected_components(pairs, "a", "b")
    # A class without a pair is a cluster by itself.
    named = members.join(component, F.col("class") == F.col("node"), "left").select("key", F.coalesce("component", "class").alias("cluster"))
    sizes = named.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1")
    return named.join(sizes, "cluster").select("key", "cluster", "size")


def body_clusters(bodies: DataFrame, key: str, source: str, percent: int = 62) -> DataFrame:
    """key, cluster, size for bodies of source that are percent alike by five-token shingles once all names are taken as one; bodies with under three
    shingles are like no other."""
    tokens = bodies.select(key, normalized_tokens(F.col(source)).alias("tokens"))
    texts = with_shingles(tokens.select(key, F.array_join("tokens", " ").alias("text")), "text").where(F.size("s") >= 3).select(key, "text")
    return near_clusters(texts, key, "text", 5, percent)


def block_sizes(entities: DataFrame, keys: Column, limit: int = 400) -> DataFrame:
    """block, size, dropped: the blocks that entities with these keys fall into, and which are too large to compare pair by pair."""
    blocks = entities.select(F.explode(F.array_distinct(keys)).alias("block")).groupBy("block").agg(F.count("*").alias("size"))
    return blocks.withColumn("dropped", F.col("size") > limit)


def weighted_similarity(parts: list[tuple[Column, Column, int]]) -> Column:
    """Jaccard similarities of pairs of arrays, weighted in percent and summed, in thousandths."""
    total = F.lit(0)
    for a, b, weight in parts:
        common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
        total = total + jaccard(common, union, weight * 10)
    return total.cast("long")


def contract_boost(a: Column, b: Column, similarity: Column) -> Column:
    """At least ALIKE_SIMILARITY where two attribute sets, neither of them small, are nearly equal, whatever else differs."""
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    large = (F.size(a) >= V.ALIKE_PROPS_LEAST) & (F.size(b) >= V.ALIKE_PROPS_LEAST)
    return F.when(large & (common * 100 >= union * V.ALIKE_PROPS_PERCENT), F.greatest(similarity, F.lit(V.ALIKE_SIMILARITY))).otherwise(similarity).cast("long")


def contract_members(entities: DataFrame, key: str = "id", usage: str = "usage_count", recency: str = "recency", deprecated: str = "deprecated") -> DataFrame:
    """Members of the clusters that entities with like contracts (arrays props, hosts, names, renders, hooks) make: cluster (its least key), size, total_usage, rank in it, and key.

    Deprecated members come last, then the most used, then the latest first. All pairs of classes of equal contracts are compared, but only the links that join them come out.
    """
    entities = written(entities, "contracts")
    named = entities.select(key, usage, recency, deprecated).join(weighted_clusters(entities, key, V.CONTRACT_WEIGHTS, V.CLUSTER_SIMILARITY, boost=True), key)
    totals = named.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(usage).alias("total_usage"))
    order = Window.partitionBy("cluster").orderBy(deprecated, F.desc(usage), F.desc(recency), key)
    return named.withColumn("rank", F.row_number().over(order)).join(totals, "cluster")


def contract_clusters(entities: DataFrame, key: str = "id", usage: str = "usage_count", recency: str = "recency", deprecated: str = "deprecated") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): all pairs a, b, similarity of entities with like contracts, and contract_members()."""
    entities = written(entities, "contracts")
    return weighted_pairs(entities, key, V.CONTRACT_WEIGHTS, V.CLUSTER_SIMILARITY, boost=True), contract_members(entities, key, usage, recency, deprecated)


def duplicates(members: DataFrame, key: str = "id", limit: int = 40) -> DataFrame:
    """The report of the largest clusters, then the most used: cluster, size, total_usage and the member that ranks first."""
    first = members.where("rank = 1").select("cluster", "size", "total_usage", F.col(key).alias("best"))
    return first.orderBy(F.desc("size"), F.desc("total_usage"), "cluster").limit(limit)


def set_classes(entities: DataFrame, key: str, columns: list[str], asked: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, classes), both written: key and class, the least key with the same sets in all columns; and class, _size, _asked (whether it has an entity that is) and its sets. Null keys are left out."""
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    sets = entities.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), wanted.alias("_asked"), *[F.array_sort(F.array_distinct(c)).alias(c) for c in columns])
    sets = written(sets.withColumn("_same", F.sha2(F.to_json(F.struct(*columns)), 256)), "class-sets")
    first = F.min_by(F.struct(*columns), "_key").alias("_sets")
    classes = written(sets.groupBy("_same").agg(F.min("_key").alias("class"), F.countDistinct("_key").alias("_size"), F.max("_asked").alias("_asked"), first), "classes")
    members = written(sets.join(classes.select("_same", "class"), "_same").select(F.col("_key").alias(key), "class").distinct(), "class-members")
    return members, classes.select("class", "_size", "_asked", "_sets.*")


def class_pairs(entities: DataFrame, key: str, parts: list[tuple[str, int]], least: int = 550, boost: bool = False, share: int = SHARE, asked: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, pairs), both written: key and class, the least key with the same sets in all columns; and weighted_pairs() of classes by that key, and of each
    class of two or more with itself (a = b) where its sets are as much alike by this measure, as empty ones are not.

    All pairs of entities follow from these, while copies cost a row each. With asked, only pairs with a class that has such an entity. Null keys are left out.
    """
    columns = [c for c, _ in parts]
    members, one = set_classes(entities, key, columns, asked)
    pairs = weighted_pairs(one, "class", parts, least, boost, share, F.col("_asked"))
    itself = weighted_similarity([(F.col(c), F.col(c), w) for c, w in parts])
    if boost:
        itself = contract_boost(F.col(columns[0]), F.col(columns[0]), itself)
    same = one.where("_size > 1 and _asked").select(F.col("class").alias("a"), F.col("class").alias("b"), itself.alias("similarity")).where(F.col("similarity") >= least)
    return members, written(pairs.unionByName(same), "class-pairs")


def linked_members(members: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """key, class, links and cluster for what class_pairs() gives: how many others an entity is linked with, and the least key that links lead to, itself included."""
    sizes = members.groupBy(F.col("class").alias("other")).agg(F.count("*").alias("n"))
    both = F.array(F.struct(F.col("a").alias("class"), F.col("b").alias("other")), F.struct(F.col("b").alias("class"), F.col("a").alias("other")))
    # A class that is linked with itself has one row here, and no link of an entity with itself.
    links = pairs.select(F.inline(F.array_distinct(both))).join(sizes, "other").groupBy("class").agg(F.sum(F.col("n") - (F.col("class") == F.col("other")).cast("int")).alias("links"))
    component = connected_components(pairs, "a", "b").select(F.col("node").alias("class"), "component")
    of = links.join(component, "class")
    return members.join(of, "class", "left").select(key, "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", key).alias("cluster"))


def weighted_clusters(entities: DataFrame, key: str, parts: list[tuple[str, int]], least: int = 550, boost: bool = False, share: int = SHARE) -> DataFrame:
    """key, cluster: the least key that pairs of weighted_pairs() lead to, for each key that is in a pair, without a row for each pair."""
    columns, weights = [c for c, _ in parts], [w for _, w in parts]
    members, classes = set_classes(entities, key, columns)
    links = class_links(classes, columns, weights, least, boost, share)
    return members.join(connected_components(links, "a", "b"), F.col("class") == F.col("node")).select(key, F.col("component").alias("cluster"))


#: Pairs that are scored in blocks in the time that one of a prefix filter's takes to be joined.
DENSE = 100


def weighted_pairs(entities: DataFrame, key: str, parts: list[tuple[str, int]], least: int = 550, boost: bool = False, share: int = SHARE, asked: Column | None = None, carry: str | None = None, dense: int = DENSE) -> DataFrame:
    """a, b (a < b), similarity: all pairs whose weighted_similarity over array columns, heaviest first, is `least` or more.

    With asked, a condition, only pairs with an entity that meets it. With boost, contract_boost() over the heaviest column can lift a pair; it asks more of that column than `least` does.
    With carry, a column that entities of a pair have alike, such as their cluster, pairs have it too.
    What the other columns can't make up for must come from the heaviest: where its rarer members tell entities apart, candidates share one of these, by a prefix
    filter with that bound, and meet in blocks of `share` entities (meeting()). Where they don't, and there would be more candidates than a `dense`-th of all pairs, all sets are
    compared with all in blocks (set_blocks.py), equal ones once; both find the same pairs. There is no limit on pairs: where most entities are alike, the result grows with the square of the table.
    """
    (heavy, weight), *others = parts
    rest = sum(w for _, w in others) * 10
    # Half a thousandth less, as similarities are rounded each.
    bound = (least - rest - 0.5) / (weight * 10)
    if bound <= 0:
        raise ValueError("the heaviest column must be needed to reach the least similarity")
    carried = [] if carry is None else [F.col(carry).alias("carry")]
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    sets = written(entities.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), wanted.alias("asked"), *[F.array_distinct(c).alias(c) for c, _ in parts], *carried), "weighted-sets")
    terms = sets.select("key", "asked", F.size(heavy).alias("n"), F.explode(heavy).alias("t"))
    rarity = terms.groupBy("t").agg(F.count("*").alias("df"))
    placed = terms.join(rarity, "t").withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("df", "t")))
    rare = written(placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * bound) + 1).select("t", "key", "n", "asked"), "rare-members")
    met = rare.groupBy("t").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    n = sets.count()
    if met * dense >= n * n:
        columns, weights = [c for c, _ in parts], [w for _, w in parts]
        found = in_blocks(packed_sets(sets, columns, "carry" if carry else None), weights, least, boost, share, n, False).where("a <> b")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity", *([F.col("carried").alias(carry)] if carry else []))
    candidates = meeting(rare, bound, share)
    side = lambda k, s: sets.select(F.col("key").alias(k), *[F.col(c).alias(f"{s}_{c}") for c, _ in parts], *(["carry"] if carry and s == "x" else []))
    both = candidates.join(side("a", "x"), "a").join(side("b", "y"), "b")
    similar = weighted_similarity([(F.col(f"x_{c}"), F.col(f"y_{c}"), w) for c, w in parts])
    if boost:
        similar = contract_boost(F.col(f"x_{heavy}"), F.col(f"y_{heavy}"), similar)
    return both.select("a", "b", similar.alias("similarity"), *([F.col("carry").alias(carry)] if carry else [])).where(F.col("similarity") >= least)

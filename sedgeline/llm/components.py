"""P6. Splits that keep related records together: hash-to-min components, weighted rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sedgeline.functions.text import id_upper, split_key, strip
from sedgeline.session import cut, drop_cut

#: Rows of split targets that may become literals of an expression.
MOST_SPLITS = 1000


def hash_to_min(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of an edge list (a, b): the component is its smallest node.

    A cluster is kept as undirected edges (lo, hi), never as a collected set. In
    each round the node v finds m, the smallest of itself and its
    neighbours, and sends its whole cluster to m and m to every member: each pair (v, u)
    becomes the edge of m with u (with v where u is m). It is stable when every
    v is a minimum itself or knows its minimum only, which the round counts while it
    writes; the table of the round before is removed then. The number of rounds is
    logarithmic in the diameter in practice. A hub's pairs lie in many tasks (repeats are
    dropped by the key (lo, hi), minima are combined map-side, AQE splits the hub in
    the join). Loops and repeated edges are harmless; null ends are left out.
    Raises if it is not stable after ``most_rounds``.
    """
    given = edges.select("a", "b").where("a is not null and b is not null")
    old = cut(given.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    for k in range(most_rounds):
        pairs = old.select(F.explode(F.array(F.struct(F.col("lo").alias("v"), F.col("hi").alias("u")), F.struct(F.col("hi").alias("v"), F.col("lo").alias("u")))).alias("x")).select("x.*")
        least = pairs.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        seen = Observation(f"round {k}")
        joined = pairs.join(least, "v").observe(seen, F.count_if((F.col("m") != F.col("v")) & (F.col("m") != F.col("u"))).alias("moving"))
        new = cut(joined.select(F.col("m").alias("lo"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("hi")).distinct())
        drop_cut(old)
        if not seen.get["moving"]:
            stars = new.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("component")), F.struct(F.col("lo").alias("node"), F.col("lo").alias("component")))).alias("x")).select("x.*").distinct()
            alone = given.where("a = b").select(F.col("a").alias("node")).distinct().join(stars, "node", "left_anti")
            return stars.unionByName(alone.select("node", F.col("node").alias("component")))
        old = new
    raise RuntimeError(f"components are not stable after {most_rounds} rounds")


def entities(manifest: DataFrame) -> DataFrame:
    """(review_id, parent, user, split, a, b): comparable ids, null where they name nobody, and the two ends of the review's edge.

    An end is the 64-bit hash of an id with its kind; a review with one id has
    an edge to itself, one with none has null ends. Two ids of equal hash would
    only share a split without need.
    """
    rows = manifest.select(F.nullif(strip("review_id"), F.lit("")).alias("review_id"), id_upper("parent_asin").alias("parent"), id_upper("user_id").alias("user"), split_key("split_name").alias("split"))
    parent, user = (F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), F.col(c))) for c in ("parent", "user"))
    return rows.withColumn("a", F.coalesce(parent, user)).withColumn("b", F.coalesce(user, parent))


def rendezvous(component, targets: list[tuple[str, int]], salt: str):
    """The split of a component: the greatest -weight/ln(u) with u a hash of component and split."""
    scores = []
    for name, weight in sorted(targets):
        u = (F.xxhash64(component, F.lit(name), F.lit(salt)).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("s"), F.lit(name).alias("split_name")))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return best["split_name"]


def assign_splits(manifest: DataFrame, targets: DataFrame, salt: str = "42") -> DataFrame:
    """(review_id, component, split_name): every review in the split of its component.

    Reviews without product and user form a component of their own. Splits
    whose target is null or not positive get nothing; with no target left an
    error is raised. The shares are met over components: one component that
    holds more than a split's share is reported by ``split_report``, not cut.
    """
    kept = targets.select(split_key("split_name").alias("s"), F.col("target_permille").cast("long").alias("w")).where("s is not null and w > 0").groupBy("s").agg(F.sum("w").alias("w")).limit(MOST_SPLITS + 1).collect()
    if not 0 < len(kept) <= MOST_SPLITS:
        raise ValueError(f"{len(kept)} usable split targets; 1 to {MOST_SPLITS} are allowed")
    rows = cut(entities(manifest).where("review_id is not null"))
    nodes = hash_to_min(rows)
    named = rows.join(nodes, rows["a"] == nodes["node"], "left").select("review_id", F.coalesce("component", F.xxhash64(F.lit("review"), F.col("review_id"))).alias("component"))
    one = named.groupBy("review_id").agg(F.min("component").alias("component"))
    return one.withColumn("split_name", rendezvous(F.col("component"), [(r["s"], r["w"]) for r in kept], salt))


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split_name, target_permille, records, components, largest_component) of an assignment."""
    by = assigned.groupBy("split_name", "component").agg(F.count("*").alias("n")).groupBy("split_name").agg(F.sum("n").alias("records"), F.count("*").alias("components"), F.max("n").alias("largest_component"))
    t = targets.select(split_key("split_name").alias("split_name"), F.col("target_permille").cast("long").alias("target_permille")).where("split_name is not null")
    return t.join(by, "split_name", "left").na.fill(0, ["records", "components", "largest_component"])


def torn(manifest: DataFrame) -> DataFrame:
    """(entity_kind, entity_id): products and users whose rows lie in more than one present split.

    Components are formed of all rows; one whose rows name a single split tears
    nothing apart, so only the ids of the others are looked at, and those with
    two splits are reported. Splits compare case, blanks and ``-``/``_`` aside;
    rows without a split do not count.
    """
    rows = cut(entities(manifest).where("a is not null").select("parent", "user", "split", "a", "b").distinct())
    nodes = hash_to_min(rows)
    ids = rows.where("split is not null").select(F.explode(F.array(*[F.struct(F.lit(kind).alias("entity_kind"), F.col(c).alias("entity_id"), F.xxhash64(F.lit(c), F.col(c)).alias("node")) for kind, c in (("parent_asin", "parent"), ("user_id", "user"))])).alias("x"), "split").select("x.*", "split").where("entity_id is not null")
    spans = lambda by: [F.min("lo").alias("lo"), F.max("hi").alias("hi")] if by else [F.min("split").alias("lo"), F.max("split").alias("hi")]
    ids = cut(ids.groupBy("node", "entity_kind", "entity_id").agg(*spans(False)).join(nodes, "node"))
    mixed = ids.groupBy("component").agg(*spans(True)).where("lo <> hi").select("component")
    return ids.where("lo <> hi").join(mixed, "component", "left_semi").select("entity_kind", "entity_id")

"""Life of a memory: reinforcement, decay, consolidation, merging and feedback.

Every operator takes a snapshot of the table and returns the next one.  Decay and
reinforcement are projections: no shuffle, one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.functions.scoring import DecayConfig, decay_reference, decay_steps, tier
from memlattice.functions.tags import normalize_tags
from memlattice.operators.ranking import first_wins
from memlattice.schemas import MEMORY_TYPES, PUBLIC
from memlattice.session import cut_lineage

#: Ids that travel whole to every task at most.
FEW = 100_000


def _marked(records: DataFrame, ids: DataFrame) -> DataFrame:
    return records.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def reinforce(records: DataFrame, ids: DataFrame, now: float, c: DecayConfig = DecayConfig()) -> DataFrame:
    """Useful memories: stronger, counted, scored, recalled now; active ones too."""
    hit = F.col("__hit")
    put = lambda name, new: F.when(hit, new).otherwise(F.col(name))
    return (
        _marked(records, ids)
        .withColumn("strength", put("strength", F.col("strength") + c.reinforce).cast("int"))
        .withColumn("useful_count", put("useful_count", F.col("useful_count") + 1).cast("int"))
        .withColumn("useful_score", put("useful_score", F.col("useful_score") + c.consolidate_speed))
        .withColumn("last_recalled_at", put("last_recalled_at", F.lit(float(now))))
        .drop("__hit")
    )


def useless_decay(records: DataFrame, ids: DataFrame, c: DecayConfig = DecayConfig()) -> DataFrame:
    """Recalled in vain: passive memories of the middle tier lose strength, to 0 at least."""
    hit = F.col("__hit") & ~F.col("is_active") & (tier(F.col("useful_score"), c) == 1)
    weaker = F.greatest(F.lit(0), F.col("strength") - c.useless_step)
    return _marked(records, ids).withColumn("strength", F.when(hit, weaker).otherwise(F.col("strength")).cast("int")).drop("__hit")


def natural_decay(records: DataFrame, now: float, c: DecayConfig = DecayConfig()) -> DataFrame:
    """Passive memories of the lowest tier lose a point a whole cycle since they were last decayed (else recalled or made)."""
    ref = decay_reference(F.col("last_decay_at"), F.col("last_recalled_at"), F.col("created_at"))
    steps = decay_steps(F.lit(float(now)), ref, c.cycle_seconds)
    due = ~F.col("is_active") & (tier(F.col("useful_score"), c) == 0) & (steps > 0)
    return (
        records.withColumn("__steps", F.when(due, steps).otherwise(0))
        .withColumn("__ref", ref)
        .withColumn("strength", F.greatest(F.lit(0), F.col("strength") - F.col("__steps")).cast("int"))
        .withColumn("last_decay_at", F.when(F.col("__steps") > 0, F.col("__ref") + F.col("__steps") * c.cycle_seconds).otherwise(F.col("last_decay_at")))
        .drop("__steps", "__ref")
    )


def consolidate(records: DataFrame, bridge: DataFrame, now: float, c: DecayConfig = DecayConfig()) -> tuple[DataFrame, DataFrame]:
    """Decays, forgets passive memories without strength, and tag links of memories that are gone."""
    kept = natural_decay(records, now, c).filter(F.col("is_active") | (F.col("strength") > 0))
    return kept, bridge.join(kept.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")


def checked_scope(scopes: Column, default: str) -> Column:
    """The one private scope of a group, the default without any; two are an error."""
    private = F.array_distinct(F.filter(scopes, lambda s: s != PUBLIC))
    return F.when(F.size(private) > 1, F.raise_error(F.lit("memories of more than one private scope cannot be merged"))).otherwise(F.coalesce(F.get(private, F.lit(0)), F.lit(default)))


def merge_groups(records: DataFrame, groups: DataFrame, least: int = 2, default_scope: str = PUBLIC) -> DataFrame:
    """One knowledge memory a group (group_id, id, pos): strengths and counts summed, best score and recall, text of the first."""
    rows = groups.join(records, "id")
    first = lambda c: F.min_by(c, F.struct("pos", "id")).alias(c)
    merged = rows.groupBy("group_id").agg(
        F.sum("strength").cast("int").alias("strength"), F.sum("useful_count").cast("int").alias("useful_count"), F.max("useful_score").alias("useful_score"),
        F.max("last_recalled_at").alias("last_recalled_at"), first("judgment"), first("reasoning"), F.collect_set("memory_scope").alias("scopes"), F.count("*").alias("members"),
    )
    merged = merged.filter(F.col("members") >= least)
    return merged.withColumn("memory_scope", checked_scope(F.col("scopes"), default_scope)).withColumn("memory_type", F.lit(MEMORY_TYPES["knowledge"])).drop("scopes")


def normalize_actions(actions: DataFrame) -> DataFrame:
    """Valid actions: create (its source ids dropped), merge of one id or more, ``updata`` of exactly one; ids trimmed, each once."""
    name = F.lower(F.trim("action"))
    kind = F.lower(F.trim(F.col("memory.type")))
    ids = F.array_distinct(F.filter(F.transform(F.coalesce("source_memory_ids", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))
    rows = actions.withColumn("action", name).withColumn("source_memory_ids", F.when(name == "create", F.array().cast("array<string>")).otherwise(ids))
    memory = F.struct(
        kind.alias("type"), F.col("memory.judgment").alias("judgment"), F.coalesce(F.col("memory.reasoning"), F.lit("")).alias("reasoning"), normalize_tags(F.col("memory.tags")).alias("tags")
    )
    rows = rows.filter(F.col("memory").isNotNull() & kind.isin("knowledge", "event", "skill", "emotional")).withColumn("memory", memory)
    n = F.size("source_memory_ids")
    return rows.filter((F.col("action") == "create") | ((F.col("action") == "merge") & (n >= 1)) | ((F.col("action") == "updata") & (n == 1)))


def apply_actions(records: DataFrame, actions: DataFrame, now: float, scope: str = PUBLIC, base_strength: int = 10) -> DataFrame:
    """The snapshot after normalised actions (action_no besides): new rows, and merged ones in place of their sources.

    A source that several actions name goes to the first of them.
    """
    pair = actions.filter(F.col("action") != "create").select("action_no", F.posexplode("source_memory_ids").alias("pos", "id"))
    pair = cut_lineage(first_wins(pair, ["id"], [F.col("action_no"), F.col("pos")]))
    # records and actions hold texts: their rows pass by tables of ids and are never sorted
    few = pair.count() <= FEW
    meets = lambda narrow: F.broadcast(narrow) if few else narrow.hint("shuffle_hash")
    sums = pair.join(records, "id").groupBy("action_no").agg(
        F.sum("strength").alias("s"), F.sum("useful_count").alias("uc"), F.max("useful_score").alias("us"), F.max("last_recalled_at").alias("lr"), F.collect_set("memory_scope").alias("scopes")
    )
    # every merge or update keeps the actions whose sources exist; a create needs none
    rows = actions.select("action_no", "action", F.struct("memory.type", "memory.judgment", "memory.reasoning").alias("memory")).join(meets(sums), "action_no", "left").filter((F.col("action") == "create") | F.col("s").isNotNull())
    label = F.element_at(F.create_map(*[F.lit(x) for kv in MEMORY_TYPES.items() for x in kv]), F.col("memory.type"))
    new = rows.select(
        F.substring(F.sha2(F.concat_ws("\0", F.col("action_no"), F.lit(str(now)), F.col("memory.judgment")), 256), 1, 32).alias("id"),
        F.coalesce(label, F.lit(MEMORY_TYPES["knowledge"])).alias("memory_type"), F.col("memory.judgment").alias("judgment"), F.col("memory.reasoning").alias("reasoning"),
        F.coalesce("s", F.lit(base_strength)).cast("int").alias("strength"), F.lit(False).alias("is_active"), F.coalesce("uc", F.lit(0)).cast("int").alias("useful_count"),
        F.coalesce("us", F.lit(0.0)).alias("useful_score"), F.coalesce("lr", F.lit(0.0)).alias("last_recalled_at"), F.lit(0.0).alias("last_decay_at"),
        F.lit(float(now)).alias("created_at"), F.lit(float(now)).alias("updated_at"),
        checked_scope(F.coalesce("scopes", F.array().cast("array<string>")), scope).alias("memory_scope"),
    )
    return records.join(meets(pair.select("id")), "id", "left_anti").select(*new.columns).unionByName(new)


def feedback(records: DataFrame, useful: DataFrame, recalled: DataFrame, actions: DataFrame, now: float, scope: str = PUBLIC, c: DecayConfig = DecayConfig()) -> DataFrame:
    """Useful ones reinforced, recalled ones that were not weakened, then the actions."""
    wasted = recalled.select("id").join(useful.select("id"), "id", "left_anti")
    return apply_actions(useless_decay(reinforce(records, useful, now, c), wasted, c), actions, now, scope)


def demote_tasks(records: DataFrame, current: str, scope: str) -> DataFrame:
    """The other task memories of a scope have strength 1."""
    other = (F.col("memory_type") == MEMORY_TYPES["task"]) & (F.col("memory_scope") == scope) & (F.col("id") != current)
    return records.withColumn("strength", F.when(other, 1).otherwise(F.col("strength")).cast("int"))


def tier_histogram(records: DataFrame, c: DecayConfig = DecayConfig()) -> DataFrame:
    return records.groupBy(tier(F.col("useful_score"), c).alias("tier")).agg(F.count("*").alias("n"), F.sum("strength").alias("strength"))


def upsert_by_judgment(records: DataFrame, incoming: DataFrame) -> DataFrame:
    """The snapshot after a batch (record columns and seq) keyed by judgment, with ``outcome``: inserted, updated, skipped or kept.

    Of a batch the latest row of a judgment counts (later in the batch on ties).  The newest stored row of the judgment is
    replaced if the incoming is no older, else stays; other stored rows of that judgment go.
    """
    latest = first_wins(incoming, ["judgment"], [F.desc("created_at"), F.desc("seq")]).drop("seq")
    cols = [c for c in latest.columns if c != "judgment"]
    stored = first_wins(records.join(latest.select("judgment"), "judgment", "left_semi"), ["judgment"], [F.desc("created_at"), F.desc("updated_at"), F.col("id")])
    rest = records.join(latest.select("judgment"), "judgment", "left_anti").select("judgment", *cols).withColumn("outcome", F.lit("kept"))
    both = latest.select("judgment", F.struct(*cols).alias("new")).join(stored.select("judgment", F.struct(*cols).alias("old")), "judgment", "left")
    newer = F.col("old").isNull() | (F.col("new.created_at") >= F.col("old.created_at"))
    # an update keeps the stored id
    value = lambda c: F.when(newer, F.coalesce(F.col("old.id"), F.col("new.id")) if c == "id" else F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
    outcome = F.when(F.col("old").isNull(), "inserted").when(newer, "updated").otherwise("skipped")
    return both.select("judgment", *[value(c) for c in cols], outcome.alias("outcome")).unionByName(rest)


def newest_of_judgment(records: DataFrame) -> DataFrame:
    """Of rows with one judgment the newest."""
    return first_wins(records, ["judgment"], [F.desc("created_at"), F.desc("updated_at"), F.col("id")])

"""Physical stores: presence, erasure, restores, retained data, request lifecycle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceless.operators.audit import Audit
from traceless.operators.passages import scan_corpus_text  # noqa: F401
from traceless.plans.workspace import Stored

# Artifact type and edge kind of each registered store kind.
EDGE_OF_TYPE = {
    "SEARCH_INDEX_ENTRY": "INDEXED_AS",
    "CACHE_ENTRY": "COPIED_TO",
    "BACKUP_COPY": "BACKED_UP_AS",
    "MODEL_INFLUENCE": "USED_TO_TRAIN",
}


@dataclass
class StoreRegistry:
    """Stores by id: a frame, its subject key column and its artifact type."""

    stores: dict[str, tuple[DataFrame, str, str]] = field(default_factory=dict)

    def register_store(self, store_id: str, df: DataFrame, key_col: str, artifact_type: str) -> None:
        self.stores[store_id] = (df, key_col, artifact_type)

    def keys(self) -> DataFrame:
        """Distinct (store_id, subject_id) over all stores."""
        parts = [
            df.select(F.lit(name).alias("store_id"), F.col(key).alias("subject_id")).distinct()
            for name, (df, key, _) in self.stores.items()
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


def presence_matrix(registry: StoreRegistry, subjects: DataFrame) -> DataFrame:
    """One boolean per store and the sorted list of stores that still hold a subject."""
    hits = registry.keys().join(subjects.select("subject_id"), "subject_id", "left_semi")
    flags = [F.bool_or(F.col("store_id") == name).alias(name) for name in registry.stores]
    grouped = hits.groupBy("subject_id").agg(*flags)
    joined = subjects.select("subject_id").join(grouped, "subject_id", "left").fillna(False, list(registry.stores))
    held = F.array_compact(F.array(*[F.when(F.col(n), F.lit(n)) for n in sorted(registry.stores)]))
    return joined.withColumn("residual_stores", held)


def audit_stores(registry: StoreRegistry, subjects: DataFrame, now_epoch: int) -> Audit:
    """Audit built from store contents: a present subject is ACTIVE, an absent one has evidence."""
    matrix = presence_matrix(registry, subjects)
    source = next(n for n, (_, _, t) in registry.stores.items() if t == "SOURCE_RECORD")
    rows = [
        F.struct(F.lit(name).alias("store_id"), F.lit(kind).alias("type"), F.col(name).alias("present"))
        for name, (_, _, kind) in registry.stores.items()
    ]
    long = matrix.select("subject_id", F.inline(F.array(*rows)))
    node = F.concat_ws("/", "subject_id", "store_id")
    artifacts = long.select(
        node.alias("artifact_id"), "subject_id", "type",
        F.when(F.col("present"), "ACTIVE").otherwise("ERASED").alias("state"),
        F.col("present").alias("active_sink"), F.lit("").alias("purpose"),
        F.col("subject_id").alias("commitment"), F.lit(None).cast("string").alias("evidence_id"),
    )
    edges = F.create_map(*[F.lit(x) for pair in EDGE_OF_TYPE.items() for x in pair])
    lineage = long.where(F.col("store_id") != source).select(
        F.concat_ws("/", "subject_id", F.lit(source)).alias("source_id"), node.alias("target_id"),
        F.element_at(edges, F.col("type")).alias("edge_type"), F.lit(False).alias("cross_subject"),
    )
    kind = (
        F.when(F.col("type") == "CACHE_ENTRY", "CACHE_INVALIDATION")
        .when(F.col("type") == "BACKUP_COPY", "CRYPTO_ERASURE")
        .when(F.col("type") == "MODEL_INFLUENCE", "MODEL_AUDIT")
        .otherwise("ABSENCE_CHECK")
    )
    facts = F.create_map(
        F.lit("propagation_deadline"), F.lit(str(now_epoch)), F.lit("key_destroyed"), F.lit("true"), F.lit("pass"), F.lit("true"),
        F.lit("protocol_id"), F.lit("store-audit"), F.lit("reference_id"), F.col("subject_id"),
    )
    evidence = long.where(~F.col("present")).select(
        F.concat(F.lit("e-"), node).alias("evidence_id"), node.alias("artifact_id"), kind.alias("kind"),
        F.lit(True).alias("valid_signature"), F.col("subject_id").alias("commitment"), F.lit(True).alias("observed_absent"),
        F.lit(now_epoch).cast("long").alias("issued_epoch"), F.lit(None).cast("long").alias("expires_epoch"), facts.alias("metadata"),
    )
    stored = [Stored(df, label).df for df, label in ((artifacts, "store-artifacts"), (lineage, "store-lineage"), (evidence, "store-evidence"))]
    return Audit(*stored, now_epoch)


def erase(store: DataFrame, key_col: str, requests: DataFrame) -> DataFrame:
    """Store without the rows of the requested subjects."""
    gone = requests.select(F.col("subject_id").alias(key_col)).distinct()
    return store.join(gone, key_col, "left_anti")


def rebuild(store: DataFrame, key_col: str, retained: DataFrame) -> DataFrame:
    """Store rebuilt from the retained subjects only."""
    kept = retained.select(F.col("subject_id").alias(key_col)).distinct()
    return store.join(kept, key_col, "left_semi")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows each side has beyond the other (multiset difference)."""
    columns = a.columns
    signed = a.select(*columns, F.lit(1).alias("_s")).unionByName(b.select(*columns, F.lit(-1).alias("_s")))
    net = signed.groupBy(*columns).agg(F.sum("_s").alias("_net"))
    return net.agg(
        F.coalesce(F.sum(F.greatest("_net", F.lit(0))), F.lit(0)).cast("long").alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("_net"), F.lit(0))), F.lit(0)).cast("long").alias("only_right"),
    )


def retained_check(before: DataFrame, after: DataFrame, retained: DataFrame) -> DataFrame:
    """Retained rows per store before and after, with a loss flag (frames: store_id, subject_id)."""
    kept = retained.select("subject_id").distinct()
    side = lambda df, n: df.join(kept, "subject_id", "left_semi").groupBy("store_id").agg(F.count(F.lit(1)).alias(n))
    joined = side(before, "rows_before").join(side(after, "rows_after"), "store_id", "full_outer").fillna(0)
    return joined.withColumn("retained_loss", F.col("rows_after") < F.col("rows_before"))


def rewrite_bytes(before: DataFrame, after: DataFrame, key: str, payload: str) -> DataFrame:
    """Bytes a targeted deletion removes against the bytes a rebuild writes again."""
    size = F.sum(F.octet_length(F.col(payload))).cast("long")
    removed = before.join(after.select(key).distinct(), key, "left_anti").agg(F.coalesce(size, F.lit(0)).alias("targeted_bytes"))
    written = after.agg(F.coalesce(size, F.lit(0)).alias("rebuild_bytes"))
    return removed.crossJoin(F.broadcast(written))


def upsert(store: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """One current row per key: the largest version wins, the batch on ties."""
    rows = store.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    rest = F.struct(*[F.col(c) for c in store.columns if c != key])
    picked = rows.groupBy(key).agg(F.max_by(rest, F.struct(version, "_new")).alias("row"))
    return picked.select(key, "row.*").select(*store.columns)


def guarded_restore(store: DataFrame, backup: DataFrame, tombstones: DataFrame, key: str, version: str) -> DataFrame:
    """Restore rows from a backup unless a tombstone blocks their subject."""
    allowed = backup.join(tombstones.select(F.col("subject_id").alias(key)).distinct(), key, "left_anti")
    return upsert(store, allowed, key, version)


def propagate_derivatives(source: DataFrame, derived: Mapping[str, DataFrame], key: str, version: str) -> dict[str, DataFrame]:
    """Every derived store brought up to the source's rows."""
    return {name: upsert(df, source.select(*df.columns), key, version) for name, df in derived.items()}


def readable_backups(ciphers: DataFrame, keys: DataFrame) -> DataFrame:
    """Backups whose ciphertext and key both still exist."""
    return ciphers.select("subject_id").distinct().join(keys.select("subject_id").distinct(), "subject_id")


def replay_workflows(
    subjects: DataFrame, carriers: DataFrame, routes: DataFrame, guards: DataFrame, tombstones: DataFrame
) -> DataFrame:
    """Which online stores a subject returns to when every unguarded route runs once.

    ``carriers(subject_id, carrier)``; ``routes(carrier, transition_id, store)``
    say what a carrier recreates; ``guards(subject_id, transition_id)``.  A
    recreated source row rebuilds index, cache and model.
    """
    live = (
        carriers.join(tombstones.select("subject_id"), "subject_id", "left_anti")
        .join(routes, "carrier")
        .select("subject_id", "transition_id", "store")
        .join(guards, ["subject_id", "transition_id"], "left_anti")
    )
    flag = lambda s: F.bool_or(F.col("store") == s)
    hit = live.groupBy("subject_id").agg(flag("source").alias("source"), flag("cache").alias("q"), flag("model").alias("m"))
    joined = subjects.select("subject_id").join(hit, "subject_id", "left").fillna(False)
    back = F.col("source")
    return joined.select(
        "subject_id", "source", back.alias("index"), (back | F.col("q")).alias("cache"), (back | F.col("m")).alias("model"),
        (back | F.col("q") | F.col("m")).alias("regenerated"),
    )


def scan_store(table: DataFrame, key_col: str, subjects: DataFrame, roles: Mapping[str, Column]) -> DataFrame:
    """Row and role counts of the requested subjects in one store."""
    wanted = subjects.select(F.col("subject_id").alias(key_col)).distinct()
    hits = table.join(wanted, key_col, "left_semi")
    return hits.groupBy(F.col(key_col).alias("subject_id")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(test).alias(name) for name, test in roles.items()]
    )


def scan_corpus_tokens(documents: DataFrame, identifiers: DataFrame, text: str = "text") -> DataFrame:
    """Documents that contain an identifier as a whole token (equi-join, any corpus size)."""
    tokens = documents.select("doc_id", F.explode(F.array_distinct(F.split(F.lower(text), r"[^a-z0-9@._+-]+"))).alias("token"))
    wanted = identifiers.select("identifier", F.lower("identifier").alias("token"))
    return tokens.join(wanted, "token").select("identifier", "doc_id").distinct()


def corpus_residuals(subjects: DataFrame, hits: DataFrame, root_present: bool) -> DataFrame:
    """Tri-state residue per identifier; unknown (null) when the corpus root is missing."""
    found = hits.select("identifier").distinct().withColumn("hit", F.lit(True))
    flag = F.coalesce("hit", F.lit(False)) if root_present else F.lit(None).cast("boolean")
    return subjects.select("identifier").join(found, "identifier", "left").select("identifier", flag.alias("residual"))


# --- request lifecycle -------------------------------------------------------

# Stages and the action that leads out of each.
STAGES = (
    "NO_REQUEST",
    "REQUESTED",
    "VISIBLE_COPIES_ERASED",
    "RECURRENCE_OBSERVED",
    "RECOVERY_LOCALIZED",
    "CUT_APPLIED",
    "VERIFIED",
)
ACTIONS = ("create-request", "delete-visible", "simulate-recovery", "run-probes", "apply-exact-cut", "verify-replay")
# Verdict per stage.
STAGE_VERDICTS = ("NOT_REQUESTED", "INCOMPLETE", "UNVERIFIED", "INCOMPLETE", "INCOMPLETE", "UNVERIFIED", "COMPLETE")


def lifecycle(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """Stage per request and the number of events that were not legal when they came.

    The stages form a line, so stage k is reached at the first k-th action after
    stage k-1: six small min-aggregations instead of an ordered scan per request.
    """
    key = F.struct(*order)
    narrow = Stored(events.select("request_id", "action", key.alias("at")), "lifecycle").df
    totals = narrow.groupBy("request_id").agg(F.count(F.lit(1)).alias("events"))
    reached = None
    current = None
    for stage, action in enumerate(ACTIONS, start=1):
        mine = narrow.where(F.col("action") == action)
        if current is not None:
            mine = mine.join(current, "request_id").where(F.col("at") > F.col("since"))
        current = Stored(mine.groupBy("request_id").agg(F.min("at").alias("since")), f"stage-{stage}").df
        row = current.select("request_id", F.lit(stage).alias("stage_no"))
        reached = row if reached is None else reached.unionByName(row)
    top = reached.groupBy("request_id").agg(F.max("stage_no").alias("stage_no"))
    joined = totals.join(top, "request_id", "left").withColumn("stage_no", F.coalesce("stage_no", F.lit(0)))
    names = F.array(*[F.lit(s) for s in STAGES])
    return joined.select(
        "request_id",
        F.element_at(names, F.col("stage_no") + 1).alias("stage"),
        F.col("stage_no").cast("long").alias("stage_no"),
        (F.col("events") - F.col("stage_no")).alias("illegal_events"),
    )


def stage_views(state: DataFrame) -> DataFrame:
    """Verdict, next action and artifact states of each request's stage."""
    verdicts = F.array(*[F.lit(v) for v in STAGE_VERDICTS])
    following = F.array(*[F.lit(a) for a in ACTIONS], F.lit(None))
    n = F.col("stage_no")
    visible = F.when(n <= 1, "ACTIVE").otherwise("ERASED")
    restored = F.when((n <= 1) | n.isin(3, 4), "ACTIVE").otherwise("ERASED")
    carrier = F.when((n <= 1) | n.isin(3, 4), "ACTIVE").when(n == 2, "LATENT").otherwise("ERASED")
    model = F.when(n <= 1, "ACTIVE").when(n.isin(2, 3, 4), "UNVERIFIED").otherwise("ERASED")
    return state.select(
        "request_id", "stage", F.element_at(verdicts, n.cast("int") + 1).alias("verdict"), F.get(following, n.cast("int")).alias("next_action"),
        visible.alias("visible_state"), restored.alias("template_state"), carrier.alias("carrier_state"), model.alias("model_state"),
    )


def overview(state: DataFrame) -> DataFrame:
    """Requests per stage, with zero for stages without requests."""
    counts = state.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    stages = state.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage"))
    return stages.join(counts, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("requests"))


def search_subjects(df: DataFrame, query: str, columns: Sequence[str], order: Sequence[str], limit: int) -> DataFrame:
    """Case-insensitive substring search over some columns, top ``limit`` by ``order``."""
    if not 1 <= limit <= 512:
        raise ValueError("limit must be between 1 and 512")
    needle = query.strip().lower()
    hit = F.lit(needle == "")
    for column in columns:
        hit = hit | F.contains(F.lower(F.col(column).cast("string")), F.lit(needle))
    return df.where(hit).orderBy(*order).limit(limit)

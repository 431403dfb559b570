"""Cognitive chunks: each pair of neighbouring blocks gets a join score of nine terms, chunks end at its valleys.

One exchange by document serves all windows; a document's recurrences (budget, healing) are folds over its arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.arrays import budget_breaks, let, running_sums, scan
from loam.operators.enrichment import entity_overlap, heading_continuity, marker_strength, noun_phrase_overlap

SOFT, HARD = 512, 768
#: Weights of the terms.
WEIGHTS = {"sim": 0.30, "entity": 0.20, "relation": 0.0, "discourse": 0.10, "heading": 0.10, "struct": 0.05, "orphan": 0.20, "shift": 0.15, "budget": 0.10}
#: Affinity of a kind to the kind after it; 0 for all others.
AFFINITY = {
    ("Heading", "Sentence"): 0.9, ("Heading", "List"): 0.85, ("Heading", "Table"): 0.8, ("Heading", "CodeBlock"): 0.8,
    ("Sentence", "CodeBlock"): 0.6, ("Sentence", "Table"): 0.6, ("Sentence", "List"): 0.5, ("CodeBlock", "Sentence"): 0.4, ("Table", "Sentence"): 0.4,
}
#: From where on a term is a reason.
REASON_FROM = {"orphan": 0.5, "discourse": 0.7, "entity": 0.5, "relation": 0.3, "heading": 0.5, "shift": 0.6, "budget": 0.5}
DOMINANT = 5


def structural_affinity(a: Column, b: Column) -> Column:
    out = F.lit(0.0)
    for (x, y), value in AFFINITY.items():
        out = F.when((a == x) & (b == y), F.lit(value)).otherwise(out)
    return out


def orphan_risk(pronoun: Column, demonstrative: Column, discourse: Column, after_heading: Column, overlap: Column) -> Column:
    part = lambda flag, value: F.when(flag, F.lit(value)).otherwise(F.lit(0.0))
    shared = F.when(overlap > 0.3, overlap * 0.3).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), part(pronoun, 0.8) + part(demonstrative, 0.6) + part(discourse, 0.4) + part(after_heading, 0.9) + shared)


def budget_pressure(tokens_so_far: Column, soft: int) -> Column:
    if soft <= 0:
        return F.lit(0.0)
    return F.least(F.greatest(tokens_so_far / F.lit(float(soft)) - 0.5, F.lit(0.0)), F.lit(1.0))


def score_boundaries(rows: DataFrame, key: str = "doc_id", soft: int = SOFT, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """One row for each pair of neighbouring blocks of enriched rows with ``sim`` (null: 0.5) on the left one."""
    w = Window.partitionBy(key).orderBy("block_idx")
    right = F.lead(F.struct("kind", "entities", "noun_phrases", "marker", "pronoun", "demonstrative", "heading_path", "tokens")).over(w)
    so_far = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 1))
    pairs = rows.select(key, F.col("block_idx").alias("boundary_idx"), "kind", "entities", "noun_phrases", "heading_path", F.coalesce("sim", F.lit(0.5)).alias("sim"), right.alias("r"), so_far.alias("tokens_so_far")).where("r is not null")
    overlap = entity_overlap(F.col("entities"), F.col("r.entities"))
    scored = (
        pairs.withColumn("overlap", overlap)
        .withColumn("entity", (F.col("overlap") + noun_phrase_overlap(F.col("noun_phrases"), F.col("r.noun_phrases"))) / 2)
        .withColumn("relation", F.lit(0.0))
        .withColumn("discourse", marker_strength(F.col("r.marker")))
        .withColumn("heading", heading_continuity(F.col("heading_path"), F.col("r.heading_path")))
        .withColumn("struct", structural_affinity(F.col("kind"), F.col("r.kind")))
        .withColumn("shift", 1 - F.col("sim"))
        .withColumn("orphan", orphan_risk(F.col("r.pronoun"), F.col("r.demonstrative"), F.col("r.marker").isNotNull(), (F.col("kind") == "Heading") & (F.col("r.kind") != "Heading"), F.col("overlap")))
        .withColumn("budget", budget_pressure(F.col("tokens_so_far"), soft))
    )
    plus = [F.lit(weights[c]) * F.col(c) for c in ("sim", "entity", "relation", "discourse", "heading", "struct", "orphan")]
    total = plus[0]
    for term in plus[1:]:
        total = total + term
    total = total - F.lit(weights["shift"]) * F.col("shift") - F.lit(weights["budget"]) * F.col("budget")
    return scored.withColumn("join_score", total).withColumn("reasons", reasons()).select(
        key, "boundary_idx", "sim", "entity", "relation", "discourse", "heading", "struct", "shift", "orphan", "budget", "join_score", "reasons", "tokens_so_far",
        F.col("r.pronoun").alias("pronoun"), F.col("r.demonstrative").alias("demonstrative"), F.col("r.marker").alias("marker"),
        (F.col("kind") == "Heading").alias("left_heading"), (F.col("r.kind") == "Heading").alias("right_heading"), F.col("heading_path").alias("from_path"), F.col("r.heading_path").alias("to_path"),
    )


def reasons() -> Column:
    two = lambda label, c: F.format_string(f"{label} (%.2f)", F.col(c))
    return F.array_compact(F.array(
        F.when(F.col("orphan") > REASON_FROM["orphan"], F.lit("high orphan risk")),
        F.when(F.col("discourse") > REASON_FROM["discourse"], two("discourse continuation", "discourse")),
        F.when(F.col("entity") > REASON_FROM["entity"], two("entity continuity", "entity")),
        F.when(F.col("relation") > REASON_FROM["relation"], two("relation continuity", "relation")),
        F.when(F.col("heading") < REASON_FROM["heading"], F.lit("heading change")),
        F.when(F.col("shift") > REASON_FROM["shift"], two("topic shift", "shift")),
        F.when(F.col("budget") > REASON_FROM["budget"], F.format_string("budget pressure (%d tokens)", F.col("tokens_so_far"))),
    ))


#: What a reason's text begins with, and the type it stands for.
REASON_TYPES = {
    "high orphan risk": "ContinuationGlue", "discourse continuation": "DiscourseBreak", "entity continuity": "EntityDiscontinuity", "heading change": "HeadingChange",
    "topic shift": "TopicShift", "relation continuity": "PropositionComplete", "budget pressure": "BudgetCeiling", "hard budget ceiling": "BudgetCeiling",
}


def reason_types() -> Column:
    """The types that ``typed_reasons`` gives to a boundary's ``reasons``, without their texts."""
    past = lambda c: F.col(c) < REASON_FROM[c] if c == "heading" else F.col(c) > REASON_FROM[c]
    kinds = {"orphan": "ContinuationGlue", "discourse": "DiscourseBreak", "entity": "EntityDiscontinuity", "relation": "PropositionComplete", "heading": "HeadingChange", "shift": "TopicShift", "budget": "BudgetCeiling"}
    found = F.array_compact(F.array(*[F.when(past(c), F.lit(kind)) for c, kind in kinds.items()]))
    return let(found, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.lit("TopicShift"))))


def typed_reasons(reasons: Column, shift: Column, from_path: Column, to_path: Column) -> Column:
    """array<struct<type, value, from, to, tokens>>; a topic shift where no reason is given."""

    def make(kind: Column, text: Column) -> Column:
        is_ = lambda *names: kind.isin(*names)
        return F.struct(
            kind.alias("type"), F.when(is_("TopicShift"), shift).alias("value"),
            F.when(is_("HeadingChange"), F.array_join(from_path, " > ")).when(is_("ContinuationGlue"), text).alias("from"),
            F.when(is_("HeadingChange"), F.array_join(to_path, " > ")).alias("to"),
            F.when(is_("BudgetCeiling"), F.coalesce(F.regexp_extract(text, "([0-9]+)", 1).try_cast("int"), F.lit(0))).alias("tokens"),
        )

    def one(text: Column) -> Column:
        kind = F.lit("TopicShift")
        for start, name in REASON_TYPES.items():
            kind = F.when(F.startswith(text, F.lit(start)), F.lit(name)).otherwise(kind)
        return let(kind, lambda k: make(k, text))

    return F.when(F.size(reasons) > 0, F.transform(reasons, one)).otherwise(F.array(make(F.lit("TopicShift"), F.lit(""))))


def spread(values: Column) -> Column:
    """struct<mean, sd> of an array, null where it is empty. Scores that are a few hundredths apart often have a deviation
    of 0.01 to the last bit, which is a bound: so it is summed up in order as the queries' SQL does it, by differences
    from the mean before and after each value. ``stddev_pop`` sums up another form and rounds otherwise."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("square"), F.lit(0.0).alias("sum"))

    def step(s: Column, v: Column) -> Column:
        after = lambda m: F.struct((s["n"] + 1).alias("n"), m.alias("mean"), (s["square"] + (v - m) * (v - s["mean"])).alias("square"), (s["sum"] + v).alias("sum"))
        return let(s["mean"] + (v - s["mean"]) / (s["n"] + 1), after)

    done = lambda s: F.when(s["n"] > 0, F.struct((s["sum"] / s["n"]).alias("mean"), F.sqrt(s["square"] / s["n"]).alias("sd")))
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), zero, step, done)


def ordered_scores(signals: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """(key, scores): each document's scores in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(score).alias("v"))))
    return signals.groupBy(key).agg(listed.alias("_s")).select(key, F.col("_s.v").alias("scores"))


def with_spread(signals: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Adds ``_d``, the mean and deviation of the document's scores."""
    return signals.join(ordered_scores(signals, key, order, score).select(key, spread(F.col("scores")).alias("_d")), key, "left")


def _below(v: Column, d: Column) -> Column:
    return (d["sd"] >= 0.01) & (v < d["mean"] - 0.5 * d["sd"])


def valleys(signals: DataFrame, key: str = "doc_id", order: str = "boundary_idx", score: str = "join_score") -> DataFrame:
    """Adds ``is_valley``: half a deviation below the document's mean and no higher than either neighbour."""
    w, v = Window.partitionBy(key).orderBy(order), F.col(score)
    near = (v <= F.coalesce(F.lag(score).over(w), v)) & (v <= F.coalesce(F.lead(score).over(w), v))
    return with_spread(signals, key, order, score).withColumn("is_valley", _below(v, F.col("_d")) & near).drop("_d")


def valley_flags(scores: Column) -> Column:
    """The same for a document's scores in one array."""

    def flags(values: Column) -> Column:
        near = lambda v, k: v <= F.coalesce(F.get(values, k), v)
        return let(spread(values), lambda d: F.transform(values, lambda v, i: _below(v, d) & near(v, i - 1) & near(v, i + 1)))

    return let(scores, flags)


def ambiguous(signals: DataFrame, key: str = "doc_id", band: float = 0.5, score: str = "join_score") -> DataFrame:
    """Adds ``is_ambiguous``: within ``band`` deviations of the mean; all where scores hardly differ."""
    mean, sd = F.col("_d.mean"), F.col("_d.sd")
    near = (sd < 0.01) | (F.col(score) >= mean - band * sd) & (F.col(score) <= mean + band * sd)
    return with_spread(signals, key, "boundary_idx", score).withColumn("is_ambiguous", near).drop("_d")


def refine(signals: DataFrame, scores: DataFrame, key: str = "doc_id", weight: float = 0.7) -> DataFrame:
    """Blends reranker scores (key, boundary_idx, score) of ambiguous boundaries into similarity and join score."""
    asked = scores.select(key, "boundary_idx", F.coalesce("score", F.lit(0.5)).alias("_score"))
    joined = signals.join(asked, [key, "boundary_idx"], "left")
    blended = (1 - weight) * F.col("sim") + weight * F.col("_score")
    reason = F.concat("reasons", F.array(F.format_string("reranker score (%.2f)", F.col("_score"))))
    known = F.col("_score").isNotNull()
    return (
        joined.withColumn("join_score", F.when(known, F.col("join_score") + (blended - F.col("sim"))).otherwise(F.col("join_score")))
        .withColumn("reasons", F.when(known, reason).otherwise(F.col("reasons")))
        .withColumn("sim", F.when(known, blended).otherwise(F.col("sim")))
        .drop("_score")
    )


def breaks(signals: DataFrame, rows: DataFrame, key: str = "doc_id", hard: int = HARD) -> DataFrame:
    """(key, flags): for each document whether a chunk ends at each boundary: at valleys, and where the budget would burst."""
    flags = ordered_scores(signals, key, "boundary_idx", "join_score").select(key, valley_flags(F.col("scores")).alias("low"))
    sizes = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_idx", "tokens"))).alias("b"))
    both = sizes.join(flags, key, "left").select(key, F.col("b.tokens").alias("tokens"), F.coalesce("low", F.array().cast("array<boolean>")).alias("low"))
    return both.select(key, budget_breaks(F.col("tokens"), F.col("low"), hard).alias("flags"))


def with_chunk_ids(rows: DataFrame, flags: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``chunk``: the number of breaks before the block."""
    before = running_sums(F.concat(F.transform("flags", lambda f: f.cast("int")), F.array(F.lit(0))))
    ids = flags.select(key, F.posexplode(before).alias("block_idx", "chunk"))
    return rows.join(ids, [key, "block_idx"])


def dominant_entities(rows: DataFrame, key: str = "doc_id", chunk: str = "chunk", top: int = DOMINANT) -> DataFrame:
    """(key, chunk, dominant, all_entities): the most mentioned, ties by name, and all in order."""
    mentions = rows.select(key, chunk, F.explode("entities.normalized").alias("e")).groupBy(key, chunk, "e").agg(F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "e")))
    return mentions.groupBy(key, chunk).agg(F.slice(F.transform(ordered, lambda x: x["e"]), 1, top).alias("dominant"), F.array_sort(F.collect_set("e")).alias("all_entities"))


def build_chunks(rows: DataFrame, signals: DataFrame, key: str = "doc_id", chunk: str = "chunk") -> DataFrame:
    """Chunks of rows with a chunk number: text, offsets, tokens, heading path, entities, confidence, links."""
    inner = signals.select(key, F.col("boundary_idx").alias("block_idx"), "join_score")
    last = F.max("block_idx").over(Window.partitionBy(key, chunk))
    scored = rows.withColumn("_last", last).join(inner, [key, "block_idx"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"]), "")
    path = F.coalesce(F.min_by("heading_path", F.when(F.col("kind") != "Heading", F.col("block_idx"))), F.min_by("heading_path", "block_idx"))
    made = scored.groupBy(key, chunk).agg(
        text.alias("text"), F.min("offset_start").alias("offset_start"), F.max_by("offset_end", "block_idx").alias("offset_end"), F.sum("tokens").alias("tokens"),
        path.alias("heading_path"), F.coalesce(F.avg(F.when(F.col("block_idx") < F.col("_last"), F.col("join_score"))), F.lit(1.0)).alias("confidence"),
        F.min("block_idx").alias("first_block"), F.max("block_idx").alias("last_block"),
    )
    return made.join(dominant_entities(rows, key, chunk), [key, chunk], "left").withColumn("dominant", F.coalesce("dominant", F.array().cast("array<string>"))).withColumn("all_entities", F.coalesce("all_entities", F.array().cast("array<string>")))


def heal_flags(signals: DataFrame) -> DataFrame:
    """Adds ``heals``: what follows leans on what comes before, if a chunk ended here."""
    strong = F.col("marker").isin("Continuation", "Causation", "Elaboration")
    close = (F.col("entity") > 0.5) & (F.col("sim") > 0.7)
    return signals.withColumn("heals", F.col("pronoun") | F.col("demonstrative") | F.coalesce(strong, F.lit(False)) | close)


def heal(chunks: DataFrame, signals: DataFrame, key: str = "doc_id", hard: int = HARD) -> DataFrame:
    """Chunks joined from left to right with the next one where the boundary heals and both fit the budget."""
    glue = heal_flags(signals).select(key, F.col("boundary_idx").alias("last_block"), "heals")
    listed = chunks.join(glue, [key, "last_block"], "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "tokens", F.coalesce("heals", F.lit(False)).alias("heals")))).alias("c"))
    state = {"g": F.lit(-1), "used": F.lit(0).cast("long"), "heals": F.lit(False)}

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        joins = s["heals"] & (s["used"] + x["tokens"] <= hard)
        g = F.when(joins, s["g"]).otherwise(s["g"] + 1)
        return {"g": g, "used": F.when(joins, s["used"] + x["tokens"]).otherwise(x["tokens"]).cast("long"), "heals": x["heals"]}, F.array(g)

    groups = listed.select(key, F.posexplode(scan(F.col("c"), "int", state, step)).alias("chunk", "healed"))
    first = lambda c: F.min_by(c, "chunk")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("chunk", c))), lambda x: x[c])
    return chunks.join(groups, [key, "chunk"]).groupBy(key, F.col("healed").alias("idx")).agg(
        F.array_join(in_order("text"), "").alias("text"), F.min("offset_start").alias("offset_start"), F.max_by("offset_end", "chunk").alias("offset_end"),
        F.sum("tokens").alias("tokens"), first("heading_path").alias("heading_path"), F.min("confidence").alias("confidence"),
        F.slice(F.array_distinct(F.flatten(in_order("dominant"))), 1, DOMINANT).alias("dominant"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("all_entities")))).alias("all_entities"),
        F.min("first_block").alias("first_block"), F.max("last_block").alias("last_block"),
    )


def with_links(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(key).orderBy("idx")
    return chunks.withColumn("prev_idx", F.lag("idx").over(w)).withColumn("next_idx", F.lead("idx").over(w))


def shared_entities(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, entity, chunks): entities of two chunks or more of a document, with their chunks in order."""
    found = chunks.select(key, "idx", F.explode("all_entities").alias("entity")).groupBy(key, "entity").agg(F.array_sort(F.collect_set("idx")).alias("chunks"))
    return found.where(F.size("chunks") > 1)


def evaluation_rates(signals: DataFrame, flags: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rates of breaks that part what belongs together; ``flags`` are the breaks before healing, or any others."""
    broken = signals.join(flags.select(key, F.posexplode("flags").alias("boundary_idx", "is_break")), [key, "boundary_idx"])
    share = lambda c: F.coalesce(F.avg(F.when(F.col("is_break"), c.cast("double"))), F.lit(0.0))
    attached = F.avg(F.when(F.col("left_heading") & ~F.col("right_heading"), (~F.col("is_break")).cast("double")))
    return broken.groupBy(key).agg(
        share(F.col("entity") > 0.2).alias("entity_orphan_rate"), share(F.col("pronoun") | F.col("demonstrative")).alias("pronoun_boundary_rate"),
        F.coalesce(attached, F.lit(1.0)).alias("heading_attachment_rate"), share(F.col("marker").isNotNull()).alias("discourse_break_rate"),
        F.lit(0.0).alias("triple_severance_rate"), F.count_if("is_break").alias("n_breaks"), F.count(F.lit(1)).alias("n_boundaries"),
    )


def uncapped_single_blocks(chunks: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of one block list all their entities as dominant, in the block's order and as often as it names them."""
    one = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min_by("entities", "block_idx").alias("_e")).where("_n = 1").select(key, F.col("_e.normalized").alias("_all"))
    return chunks.join(one, key, "left").withColumn("dominant", F.coalesce("_all", "dominant")).drop("_all")


def cognitive_chunks(rows: DataFrame, key: str = "doc_id", soft: int = SOFT, hard: int = HARD, rerank: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, signals, flags) of enriched rows with ``sim``. ``rerank`` holds scores of ambiguous boundaries."""
    signals = score_boundaries(rows, key, soft)
    if rerank is not None:
        band = ambiguous(signals, key).where("is_ambiguous").select(key, "boundary_idx")
        signals = refine(signals, rerank.join(band, [key, "boundary_idx"], "left_semi"), key)
    flags = breaks(signals, rows, key, hard)
    made = build_chunks(with_chunk_ids(rows, flags, key), signals, key)
    healed = uncapped_single_blocks(heal(made, signals, key, hard), rows, key)
    return with_links(healed, key), signals, flags

"""What language models are asked: schemas of the answers, and operators that put them to use.

A client is any callable from (system, user, JSON schema) to a JSON string; see ``providers.http.Completion``. Failures
give null, and what is null falls back to the local stand-ins.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.providers.http import complete_column

Client = Callable[[str, str, dict], str]
STRING = {"type": "string"}
#: Bytes of a section tree that one request may hold; the cut never splits a character.
TREE_BYTES = 100_000


def _list(**fields: dict) -> dict:
    return {"type": "array", "items": {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}}


def _object(**fields: dict) -> dict:
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


RELATIONS = _object(relations=_list(subject=STRING, predicate=STRING, object=STRING))
INTENTS = _object(intents=_list(query=STRING, intent_type={"type": "string", "enum": ["factual", "procedural", "comparative", "exploratory"]}))
SYNOPSIS = _object(synopsis=STRING)
SECTIONS = _object(sections=_list(section_id={"type": "integer"}, classification={"type": "string", "enum": ["atomic", "splittable", "merge_candidate"]}))
PARTITION = _object(chunks=_list(section_ids={"type": "array", "items": {"type": "integer"}}, block_range={"type": "array", "items": {"type": "integer"}}))
METADATA = _object(
    title=STRING, summary=STRING, keywords={"type": "array", "items": STRING}, typed_entities=_list(name=STRING, entity_type=STRING),
    hypothetical_questions={"type": "array", "items": STRING}, semantic_keys={"type": "array", "items": STRING}, category=STRING,
)
METADATA_DDL = "title string, summary string, keywords array<string>, typed_entities array<struct<name:string,entity_type:string>>, hypothetical_questions array<string>, semantic_keys array<string>, category string"


def relations(text: Column, make_client: Callable[[], Client]) -> Column:
    """array<struct<subject, predicate, object, confidence>> of a chunk; empty for short texts and failures."""
    got = complete_column(text, "List the relations stated in the text.", RELATIONS, "relations array<struct<subject:string,predicate:string,object:string>>", make_client)
    sure = F.transform(got["relations"], lambda r: F.struct(r["subject"].alias("subject"), r["predicate"].alias("predicate"), r["object"].alias("object"), F.lit(1.0).alias("confidence")))
    return F.coalesce(sure, F.array().cast("array<struct<subject:string,predicate:string,object:string,confidence:double>>"))


def synopsis(text: Column, make_client: Callable[[], Client]) -> Column:
    return complete_column(text, "Say in one sentence what the text is about.", SYNOPSIS, "synopsis string", make_client)["synopsis"]


def intents(docs: DataFrame, make_client: Callable[[], Client], embed: Callable[[Column], Column], limit: int = 20, key: str = "doc_id") -> DataFrame:
    """(key, intent_idx, query, intent_type, embedding): questions that readers of each document may ask."""
    got = complete_column(F.col("text"), f"Predict up to {limit} questions this text answers.", INTENTS, "intents array<struct<query:string,intent_type:string>>", make_client)
    rows = docs.select(key, F.posexplode(F.slice(got["intents"], 1, limit)).alias("intent_idx", "i"))
    return rows.select(key, "intent_idx", F.col("i.query").alias("query"), F.col("i.intent_type").alias("intent_type"), embed(F.col("i.query")).alias("embedding"))


def _tree_json(tree: DataFrame, key: str) -> DataFrame:
    node = F.struct("node_id", "parent_id", "node_type", "level", "heading", "start", "end", "tokens", "preview")
    whole = F.to_json(F.array_sort(F.collect_list(node)))
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(whole.cast("binary"), 1, TREE_BYTES).cast("string")), "�+$", "")
    return tree.groupBy(key).agg(cut.alias("text"))


def inspect_sections(tree: DataFrame, make_client: Callable[[], Client], key: str = "doc_id") -> DataFrame:
    """The tree with ``class`` from a model; sections it does not name, or names otherwise, are atomic."""
    got = complete_column(F.col("text"), "Classify every section of this tree.", SECTIONS, "sections array<struct<section_id:int,classification:string>>", make_client)
    named = _tree_json(tree, key).select(key, F.explode(got["sections"]).alias("s")).select(key, F.col("s.section_id").alias("node_id"), F.col("s.classification").alias("class"))
    known = named.where(F.col("class").isin("atomic", "splittable", "merge_candidate")).dropDuplicates([key, "node_id"])
    return tree.join(known, [key, "node_id"], "left").withColumn("class", F.coalesce("class", F.lit("atomic")))


def refine_partition(tree: DataFrame, make_client: Callable[[], Client], key: str = "doc_id") -> DataFrame:
    """(key, part, section_ids, start, end) as a model partitions each document's sections."""
    got = complete_column(F.col("text"), "Partition the document's blocks into chunks.", PARTITION, "chunks array<struct<section_ids:array<int>,block_range:array<int>>>", make_client)
    rows = _tree_json(tree, key).select(key, F.posexplode(got["chunks"]).alias("part", "c"))
    ends = tree.groupBy(key).agg(F.max("end").alias("_n"))
    return rows.join(ends, key).select(
        key, "part", F.col("c.section_ids").alias("section_ids"), F.coalesce(F.get("c.block_range", F.lit(0)), F.lit(0)).alias("start"), F.coalesce(F.get("c.block_range", F.lit(1)), F.col("_n")).alias("end")
    )


def rolling_metadata(chunks: DataFrame, make_client: Callable[[], Client], key: str = "doc_id") -> DataFrame:
    """Chunks with the seven fields, asked one after another within a document: each request names the keys so far, so
    that the model takes them up again. A document is one group; documents go in parallel."""
    fields = [x.split()[0] for x in METADATA_DDL.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        client, known, answers = make_client(), [], []
        for text in frame.sort_values("idx")["text"]:
            try:
                got = json.loads(client("Describe the chunk. Keys so far: " + ", ".join(known), text, METADATA))
            except (OSError, ValueError, KeyError):
                got = {}
            known.extend(k for k in map(str.lower, got.get("semantic_keys") or []) if k not in known)
            answers.append([got.get(f) for f in fields])
        out = frame.sort_values("idx").reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(answers, columns=fields)], axis=1)

    plain = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.groupBy(key).applyInPandas(run, f"{plain}, {METADATA_DDL}")

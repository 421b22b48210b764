"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


DOCUMENT = _struct(doc_id=_S, text=_S, filepath=_S, file_size=_I, hash=_S)
SPAN = T.StructType([T.StructField("start", _I), T.StructField("end", _I), T.StructField("label", _S), T.StructField("text", _S)])
EXTRACTION = _struct(
    doc_id=_S,
    text=_S,
    spans=T.ArrayType(SPAN),
    metadata=_struct(filepath=_S, file_size=_I, processing_time=_S, hash=_S, total_labels_found=_I),
    stats=_struct(
        rule_based_entities=_I, llm_entities=_I, total_entities=_I, rule_stats=T.MapType(_S, _I), label_distribution=T.MapType(_S, _I), unique_labels=T.ArrayType(_S)
    ),
)
ANSWERS = _struct(text=T.ArrayType(_S), answer_start=T.ArrayType(_I))
QA = _struct(id=_S, doc_id=_S, question=_S, context=_S, answers=ANSWERS, metadata=_struct(entity_label=_S, num_answers=_I, generation_date=_S))
EMBEDDING = _struct(doc_id=_S, context=_S, embedding=T.ArrayType(T.FloatType()))
RETRIEVAL = _struct(query=_S, rank=_I, context=_S, score=_D, doc_id=_S, model=_S)
TAG = _struct(tag_id=_I, cat=_S, sub=_S, field=_S, code=_S, phrase=_S)
MODEL = _struct(key=_S, hf_name=_S, pooling=_S, max_seq_length=_I, category=_S, description=_S)
EVALUATION = _struct(
    model_name=_S,
    model_category=_S,
    mean_similarity=_D,
    std_similarity=_D,
    min_similarity=_D,
    max_similarity=_D,
    median_similarity=_D,
    recall_at_1=_D,
    recall_at_5=_D,
    recall_at_10=_D,
    ndcg_at_5=_D,
    ndcg_at_10=_D,
    mrr=_D,
    map_at_5=_D,
    params=_L,
    model_size_mb=_D,
    inference_time_ms=_D,
)

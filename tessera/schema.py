"""Record types as Spark structs."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
VECTOR = T.ArrayType(D, containsNull=False)
ATTRIBUTES = T.MapType(S, S)
GEO = T.StructType([T.StructField(n, S) for n in ("city", "country", "venue")] + [T.StructField(n, D) for n in ("lat", "lon")])
GEO_BIAS = T.StructType([T.StructField(n, S) for n in ("city", "country", "region", "timezone")])
TIME_WINDOW = T.StructType([T.StructField("start", TS), T.StructField("end", TS)])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


USER = _struct(id=S, display_name=S, location=GEO_BIAS, created_at=TS)
SAVED_QUERY = _struct(id=S, user_id=S, text=S, city=S, country=S, domain=S, tags=T.ArrayType(S), window=TIME_WINDOW, schedule_cron=S, schedule_text=S, max_results_shown=I, last_run_at=TS, enabled=B, created_at=TS)
EXPANDED_QUERY = _struct(id=S, saved_query_id=S, text=S)
EXTRACTED = _struct(url=S, title=S, description=S, starts_at=TS, ends_at=TS, city=S, country=S, venue=S, image_url=S, attributes=ATTRIBUTES, price=S)
RAW_RESULT = _struct(id=S, source_query_id=S, source_engine=S, url=S, title=S, description=S, starts_at=TS, ends_at=TS, geo=GEO, image_url=S, attributes=ATTRIBUTES, price=S, rank=I, score=D, fetched_at=TS)
CANONICAL = _struct(id=S, url=S, title=S, description=S, starts_at=TS, ends_at=TS, geo=GEO, image_url=S, attributes=ATTRIBUTES, price=S, source_search_result_ids=T.ArrayType(S), embedding=VECTOR, first_seen_at=TS, last_seen_at=TS, city_key=S, starts_epoch=L)
PROVENANCE = _struct(canonical_id=S, winners=T.MapType(S, S))
OUTCOME = _struct(candidate_id=S, decision=S, canonical_id=S, similarity=D)
LINK = _struct(seq=L, query_id=S, canonical_id=S)
FEEDBACK = _struct(id=S, saved_query_id=S, canonical_search_result_id=S, kind=S, reason=S, created_at=TS)
PREFERENCE = _struct(saved_query_id=S, nl_summary=S, liked_centroid=VECTOR, disliked_centroid=VECTOR, like_count=I, dislike_count=I, updated_at=TS)
SHOWN = _struct(user_id=S, result_id=S, shown_at=TS)
RANKED = _struct(canonical_id=S, score=D, rank=I, rationale=S, is_exploration=B)
EVAL_CASE = _struct(name=S, stage=S, golden_ids=T.ArrayType(S))
DELETED = _struct(id=S)
TABLES = {"deleted_queries": DELETED, "users": USER, "saved_queries": SAVED_QUERY, "raw_results": RAW_RESULT, "canonical": CANONICAL, "provenance": PROVENANCE, "query_results": LINK, "feedback": FEEDBACK, "preferences": PREFERENCE, "shown_ledger": SHOWN}

"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from stallmark.plans import answers, captures, documents, listings, pricing, stream, texts, transitions

#: Query functions by module; the SQL of each is the constant of its name in capitals, where there is one.
NAMES = {
    pricing: ["market_statistics", "price_statistics", "price_percentiles", "comparables_range", "comparables_uncapped", "comparables_null_tolerant", "top250_pool", "deterministic_score", "verdict_distribution", "combined_score", "price_changes", "price_histories", "price_drop"],
    texts: ["normalize_title", "nullable_text", "redact_text", "normalize_url", "parse_price", "mileage", "fingerprint", "content_change", "token_similarity", "places", "model_signature", "categories", "extract_vehicle", "extract_gpu", "extract_notebook", "extract_generic", "filter_reason_lists"],
    listings: ["dedup_first", "union_batches", "invalid_rows", "latest_analysis", "canonical_pairs", "one_notification", "resolve_identity", "cross_match", "similar_titles", "exclude_cross_posts", "greedy_collapse", "due_searches", "needs_details", "claim_transition", "search_links", "upsert_snapshot", "suppress", "recent_listings", "search_report", "deal_report"],
    captures: ["facebook_cards", "olx_cards", "mercadolivre_cards", "facebook_pages", "json_ld", "listed_attributes", "api_items", "api_details", "api_pages", "page_source", "search_order", "merged_details", "first_party_ids", "gate_reasons", "details_reasons", "matching_details", "numbers_or_errors", "category_data", "run_counters"],
    transitions: ["fenced_updates", "updated_details", "snapshot_batches", "saved_extractions", "saved_analyses", "reused_analyses", "settled_notifications", "leased_searches", "lease_contention", "saved_matches", "merged_supplements", "search_reasons", "search_definitions", "legacy_searches", "table_checks", "comparables_vehicle", "comparables_eligible", "comparables_gpu", "comparables_notebook", "comparables_electronics"],
    documents: ["document_reasons", "kept_answers", "extraction_rejects"],
    answers: ["card_models", "inferred_models", "model_runs", "search_criteria"],
    stream: ["stream_price_changes", "stream_late_prices", "stream_outbox", "stream_schedule"],
}
QUERIES = {name: getattr(module, name) for module, names in NAMES.items() for name in names}
ORACLE_SQL = {name: getattr(module, name.upper()) for module, names in NAMES.items() for name in names if hasattr(module, name.upper())}

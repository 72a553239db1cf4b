"""Registered queries against their SQL at the smallest scale."""

import duckdb
import pandas as pd
import pytest

TABLES = ["documents", "embeddings", "benchmark", "conversations", "events", "labels", "lineitem", "orders", "pages"]
FAST = ["tokenize_document", "query_terms", "path_rules", "eval_symbols", "embed_text_truncated", "placements", "branch_visibility", "pending_volume", "bm25_chunk_topk", "vector_exact_topk",
        "hybrid_files", "rerank_fuse", "grep_baseline", "bm25_baseline", "metrics_macro", "interval_enclosing", "dataset_stats", "token_bucket_wait", "request_dispatch", "budget_levels", "budget_assembly", "symbol_scan", "function_truth", "function_metrics", "budget_curve", "context_merge"]


def rows(df):
    df = df[sorted(df.columns)]
    say = lambda v: "" if pd.isna(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(say(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, data, name):
    import __spark_entry__ as entry

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, data).toPandas()) == rows(c.sql(entry.oracle_sql()[name]).df())


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pending_volume_of_a_line_whose_limit_is_inside_a_character(spark, tmp_path):
    """Lines over the limit, cut at each byte of a character; whatever their chunks' hashes, some of them are pending."""
    import __spark_entry__ as entry

    c = duckdb.connect()
    texts = [(i, "\n".join("x" * (n % 3) + "€" * (9000 + i) for n in range(4)), "en", "web", 0) for i in range(40)]
    c.execute("create table t (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    c.executemany("insert into t values (?, ?, ?, ?, ?)", texts)
    c.execute(f"copy t to '{tmp_path}/documents.parquet' (format parquet)")
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    assert rows(entry.queries()["pending_volume"](spark, str(tmp_path)).toPandas()) == rows(c.sql(entry.oracle_sql()["pending_volume"]).df())

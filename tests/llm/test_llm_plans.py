"""Passes that must not shuffle texts, and the native operator."""

import re

from quillspark.llm import bpe, hamming, htmltext, pii, secrets, urlfilter

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_single_passes(spark):
    for df in (bpe.op1_bpe(spark, FOLDER), secrets.op3_secrets(spark, FOLDER), htmltext.op9_html_text(spark, FOLDER)):
        text = plan(df)
        assert "Exchange" not in text
        assert not re.search(r"ReadSchema: struct<[^>]*(?:lang|source|n_chars)", text)


def test_pii_and_others_stay_native(spark):
    for df in (pii.op5_pii(spark, FOLDER), urlfilter.op4_url_filter(spark, FOLDER), hamming.op10_hamming_top_k(spark, FOLDER)):
        assert not re.search("Python|Pandas|MapInArrow", plan(df))

"""Secrets of digits alone."""

from __future__ import annotations

from tidemark.llm import surrogates


def test_secrets_need_no_check_digit(spark):
    rows = [(1, 'password = "1234567890123456" and more'), (2, "token: 4111111111111112"), (3, "Order 4111111111111112"), (4, "token: abc and 1234567890123456")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in surrogates.replace_private(frame).collect()}
    assert "1234567890123456" not in got[1] and got[1].startswith('password = "') and got[1].endswith('" and more')
    assert len(got[1]) == len(rows[0][1]) and "4111111111111112" not in got[2]
    assert got[3] == rows[2][1] and got[4] == rows[3][1]

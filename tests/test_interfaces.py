"""Calls, errors and plans that callers rely on."""

from __future__ import annotations

import json
import sys
import zipfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.operators import agents, chunking, ordering, rag
from tidemark.providers import GenAIChatClient, GenAIEmbeddingClient
from tidemark.sources import index, loaders, managed

PLANS = [
    '{"tool_calls": [{"name": "a", "arguments": {"x": [1, "y"]}}, {"name": "b"}]}', '{"tool_calls": null}', '{"tool_calls": null, "final_answer": "done"}',
    '{"tool_calls": ["x", 3, {"name": 7, "arguments": "text"}]}', '{"tool_calls": [{"name": "a", "arguments": null}]}', '{"tool_calls": []}',
    '{"tool_calls": "later", "final_answer": "now"}', '{"final_answer": 3}', '{"final_answer": null}', '["tool_calls"]', "plain", "", "null", '{"other": 1}',
]


def test_plans_of_any_shape_are_read_alike(spark):
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(PLANS)], "i int, reply string")
    rows = frame.select("i", *[c.alias(n) for n, c in agents.plan_columns(F.col("reply")).items()]).orderBy("i").collect()
    for row, reply in zip(rows, PLANS):
        final, calls = agents.parse_plan(reply)
        assert row.final == final, reply
        assert [(c.id, c.name, json.loads(c.arguments)) for c in row.calls] == [(c.id, c.name, c.arguments) for c in calls], reply
    assert agents.parse_plan(None) == (None, [])
    assert [c.id for c in agents.parse_plan(PLANS[3])[1]] == ["2"]


def test_tools_and_callbacks_take_the_named_parts():
    tool = agents.Tool(name="add", description="", parameters={}, function=lambda a, b: a + b)
    told, replies = [], iter(['{"tool_calls": [{"name": "add", "arguments": {"a": 1, "b": 2}}]}', '{"final_answer": "3"}'])
    answer = agents.run_agent_loop(agents.JsonFunctionAdapter(lambda m: next(replies)), [], [tool], 8, lambda name, result: told.append((name, result)))
    assert answer == "3" and told == [("add", 3)]


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't know this module


class Counting(GenAIChatClient):
    """Counts its calls in a file, as workers are other processes."""

    path = ""

    def chat(self, user_input, system_prompt=None, max_tokens=1024, temperature=1.0, top_k=1.0):
        with open(self.path, "a") as f:
            f.write(f"{max_tokens}\n")
        return super().chat(user_input, system_prompt, max_tokens, temperature, top_k)


def counting(tmp_path, **replies) -> Counting:
    client = Counting("stub", replies=replies.get("replies", {}))
    client.path = str(tmp_path / "calls")
    open(client.path, "w").close()
    return client


def calls(client: Counting) -> list[int]:
    return [int(x) for x in open(client.path)]


def test_question_generation_stops_at_its_cap_and_keeps_other_keys(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"text {i} " * 5) for i in range(100)], "doc_seq long, content string")
    client = counting(tmp_path, replies={"": '[{"question": "q", "ground_truth": "g", "source": "s"}, {"question": "r", "level": 2}]'})
    maker = rag.EvalDatasetGroundTruthGenerator(client)
    got = maker.process_dataframe(frame, max_chars=50, max_total_pairs=5)
    assert got.columns == ["question", "ground truth", "level", "source"] and got.count() == 5
    assert len(calls(client)) == rag.FIRST_ROUND
    assert maker.process_dataframe(frame, max_chars=50, max_total_pairs=30).count() == 30
    assert len(calls(client)) == 4 * rag.FIRST_ROUND
    assert maker.process_dataframe(frame.limit(3), max_chars=50, max_total_pairs=100).count() == 6
    assert maker.process_dataframe(frame.limit(0), max_total_pairs=3).count() == 0 == maker.process_dataframe(frame.limit(0)).count()


def test_infer_takes_positions_and_passes_its_tokens_on(spark, tmp_path):
    client = counting(tmp_path)
    frame = spark.createDataFrame([(0, "tides follow the moon")], "doc_seq long, content string")
    embed = GenAIEmbeddingClient("hash")
    path, _ = index.VectorEmbedding(embed, 60, 5).generate_index(frame, "content", str(tmp_path / "ix"))
    found = rag.RAGInferencer(embed, client).infer("s", "what do tides follow", 2, 17, "hyde", "local_index", None, path)
    assert found.first().question == "what do tides follow" and set(calls(client)) == {17}
    with pytest.raises(FileNotFoundError):
        rag.RAGInferencer(embed, client).infer("s", "q", index_path=str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        rag.RAGInferencer(embed, client).infer("s", "q")


def test_order_breaks_ties_alike_and_takes_any_type(spark):
    rows = [(None if i % 11 == 0 else f"k{i % 3}", f"t{i}") for i in range(200)]
    schema = "k string, t string"
    a = ordering.with_position(spark.createDataFrame(rows, schema).repartition(5), "k")
    b = ordering.with_position(spark.createDataFrame(rows[::-1], schema).repartition(3), "k")
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    got = a.orderBy("id").collect()
    assert [r.id for r in got] == list(range(200)) and [r.k for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or ""))
    same = spark.createDataFrame([(1, f"t{i}") for i in range(500)], "k int, t string")
    buckets = ordering.bucketed(same, "k", 5).groupBy("_bucket").count().collect()
    assert len(buckets) == 5 and max(r["count"] for r in buckets) < 250
    chunks = chunking.chunk_corpus(same, "t", "k", 10, 0)
    assert chunks.collect() == chunks.collect()


def test_managed_index_of_texts(spark):
    embed = GenAIEmbeddingClient("hash")
    maker = index.VectorEmbedding(embed, 60, 5)
    docs = spark.createDataFrame([(0, "moon"), (1, " "), (2, "tide")], "doc_seq long, content string")
    for offset in (0, 1):  # the second overwrites id 1 and adds id 2
        maker.generate_index(docs, "content", None, index.MANAGED, catalog="", schema="", endpoint_name="tide", embedding_dim=embed.dim, index_name="ix", id_offset=offset)
    assert sorted((r.id, r.content) for r in spark.table("tide_ix").collect()) == [(0, "moon"), (1, "moon"), (2, "tide")]
    hit = rag.RAGInferencer(embed, GenAIChatClient("stub")).infer("s", "tide", 1, index_type=index.MANAGED, index="tide_ix").first()
    assert hit.retrieved_docs == ["tide"]
    managed.drop(spark, "tide_ix")
    assert not spark.catalog.tableExists("tide_ix")


def workbook(path, sheets: dict) -> None:
    """A small xlsx file with shared and inline strings, numbers, truths and gaps."""
    main = "xmlns='urn:m' xmlns:r='urn:r'"
    shared: list[str] = []
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f"<sheet name='{n}' sheetId='{i}' r:id='r{i}'/>" for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>{names}</sheets></workbook>")
        links = "".join(f"<Relationship Id='r{i}' Target='worksheets/sheet{i}.xml'/>" for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships xmlns='urn:p'>{links}</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            lines = []
            for y, row in enumerate(rows, 1):
                cells = []
                for x, value in enumerate(row):
                    at = f"{'ABCDEFG'[x]}{y}"
                    if isinstance(value, bool):
                        cells.append(f"<c r='{at}' t='b'><v>{int(value)}</v></c>")
                    elif isinstance(value, str) and x % 2:
                        cells.append(f"<c r='{at}' t='inlineStr'><is><t>{value}</t></is></c>")
                    elif isinstance(value, str):
                        shared.append(value)
                        cells.append(f"<c r='{at}' t='s'><v>{len(shared) - 1}</v></c>")
                    elif value is not None:
                        cells.append(f"<c r='{at}'><v>{value}</v></c>")
                lines.append(f"<row r='{y}'>{''.join(cells)}</row>")
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")


def test_workbooks_are_read_by_the_standard_library(spark, tmp_path):
    import pandas as pd

    workbook(tmp_path / "Book.XlsX", {"One": [["name", "n", "ok"], ["a", 1, True], ["b", 2.5, False]], "Two": [["x"], ["only"]]})
    got = {r.filename: r.content for r in loaders.load_documents_to_dataframe(spark, str(tmp_path)).collect()}
    assert got == {
        "Book.XlsX::One": pd.DataFrame({"name": ["a", "b"], "n": [1, 2.5], "ok": [True, False]}).to_string(index=False),
        "Book.XlsX::Two": pd.DataFrame({"x": ["only"]}).to_string(index=False),
    }


def test_loaders_tell_what_is_wrong(spark, tmp_path):
    (tmp_path / "A.Txt").write_text("hello", "utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "x.md").write_text("no", "utf-8")
    folder = str(tmp_path)
    assert [r.content for r in loaders.load_documents_to_dataframe(spark, folder).collect()] == ["hello"]
    assert loaders.load_and_process_single_document(spark, folder, "A.Txt").first().content == "hello"
    with pytest.raises(FileNotFoundError):
        loaders.load_and_process_single_document(spark, folder, "gone.txt")
    for name in ("x.md", "bad.txt"):
        with pytest.raises(ValueError, match="Error reading"):
            loaders.load_and_process_single_document(spark, folder, name)


def test_evaluation_size_and_limits(spark, tmp_path):
    judge = GenAIChatClient("stub", replies={"": "Answer Relevance: 1 Accuracy: 1 Completeness: 1 Clarity: 1 Semantic Similarity Score: 90%"})
    rows = spark.createDataFrame([("b", "b"), ("a", "a"), ("c", "c")], ["ground truth", "answer"]).coalesce(1)
    for most, n in ((0, 3), (None, 3), (2, 2)):
        sink = str(tmp_path / f"m{most}")
        scored, _ = rag.RagEvaluator(judge, "e", sink).evaluate(rows, max_rows=most)
        assert spark.read.parquet(sink).first().evaluation_size == n == scored.count()
    assert {r.answer for r in scored.collect()} == {"b", "a"}  # as they come, not by their text

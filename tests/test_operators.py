"""The reference operators against golden cases and plain restatements."""

from __future__ import annotations

import json
import math
import random
import textwrap
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import prompts
from tidemark.functions import text as tx
from tidemark.functions.vectors import hash_embedding, hash_vector
from tidemark.operators import agents, batching, chunking, evaluation, ordering, qa, rag, search
from tidemark.providers import SAFE_ANSWER, GenAIChatClient, GenAIEmbeddingClient, with_embedding, with_reply


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


# -- text -------------------------------------------------------------------


def test_strip_words_blank(spark):
    odd = "  a b \x1c"
    assert one(spark, odd, tx.strip) == odd.strip()
    assert one(spark, odd, tx.words) == odd.split() and one(spark, " 　", tx.words) == []
    assert one(spark, None, tx.is_blank) and one(spark, "\n", tx.is_blank) and not one(spark, "x", tx.is_blank)


def test_shorten(spark):
    for t in ["x" * 900, "ab " + "x" * 900, "", "aaa-bbb-" * 150, "a  b\nc"]:
        assert one(spark, t, tx.shorten) == textwrap.shorten(t, 800, placeholder=" [...]")
    assert one(spark, None, tx.shorten) is None


def test_templates_and_json(spark):
    assert one(spark, "T", lambda c: tx.fill("a {{b}} {context}!", context=c)) == "a {b} T!"
    assert one(spark, 'x [{"a": 1,},] ]', tx.first_json_array) == '[{"a": 1}]'
    assert one(spark, "none", tx.first_json_array) is None
    assert json.loads(one(spark, "{bad", tx.parse_arguments)) == {"_raw": "{bad"} and one(spark, None, tx.parse_arguments) == "{}"


# -- chunking, order, batches -------------------------------------------------


def test_boundary_golden_cases():
    def spans(t):
        return chunking.boundary_spans(t, 1000, 100)

    assert spans("hello") == [(0, 5)] and spans("y" * 150) == [(0, 150), (50, 150)] and spans("") == []
    assert spans("z" * 1000) == [(0, 1000), (900, 1000)]
    assert spans("z" * 1001) == [(0, 1000), (900, 1001), (901, 1001)]
    assert spans("ab " + "x" * 2000) == [(0, 2), (1000, 2000), (1900, 2003), (1903, 2003)]
    assert chunking.boundary_spans("ab " + "x" * 2000, 1000, 100, lossless=True)[1] == (2, 1002)


def test_fixed_chunks(spark):
    sizes = lambda t: [len(c) for c in one(spark, t, chunking.chunk_text)]
    assert sizes("a" * 500) == [500, 50] and sizes("a" * 1000) == [500, 500, 100] and sizes("") == []
    assert one(spark, None, chunking.chunk_text) is None
    with pytest.raises(ValueError):
        chunking.chunk_text(F.lit("x"), 10, 10)


@pytest.mark.parametrize("size,overlap", [(7, 2), (5, 0), (40, 39)])
def test_corpus_chunks_cross_documents(spark, size, overlap):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab \n\U0001f600") for _ in range(rng.randint(0, 30))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(99, None)]
    body, step = "\n".join(texts), size - overlap
    want = [body[i : i + size] for i in range(0, len(body), step)]
    frame = spark.createDataFrame(rows, "n long, t string").repartition(4)
    got = {r.chunk_id: r.content for r in chunking.chunk_corpus(frame, "t", "n", size, overlap).collect()}
    assert [got[i] for i in sorted(got)] == want
    assert chunking.chunk_corpus(frame.limit(0), "t", "n").count() == 0


def test_positions_and_heads(spark):
    frame = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "n long").repartition(5)
    assert all(r.n == r.id for r in ordering.with_position(frame, "n").collect())
    assert ordering.with_position(frame, "n", "id", 10).agg(F.min("id")).first()[0] == 10
    assert ordering.head(frame, "n", 0).count() == 0 and ordering.head_or_all(frame, "n", 0).count() == 101
    assert ordering.head(frame, "n", None).count() == 101


def plain_batches(sizes, limit):
    held, out, b, full = 0, [], 0, False
    for s in sizes:
        if full and held + s > limit:
            b, held = b + 1, 0
        held, full = held + s, True
        out.append(b)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 14), min_size=1, max_size=40), st.integers(0, 40))
def test_batch_ranges_compose(sizes, at):
    at = min(at, len(sizes))
    a, b = np.array(sizes[:at], int), np.array(sizes[at:], int)
    opens_a, used = batching.fill_batches(a, 10)
    opens_b, then = batching.fill_batches(b, 10, used)
    assert [*np.cumsum(opens_a), *(opens_a.sum() + np.cumsum(opens_b))] == plain_batches(sizes, 10)
    if used:
        assert batching.compose(batching.step_function(b, 10), int(b.sum()), used) == (opens_b.sum(), then)


def test_greedy_batches(spark):
    rng = random.Random(1)
    texts = [rng.choice(["", None, "  "]) if rng.random() < 0.2 else " " + "x" * rng.randint(1, 130) for _ in range(150)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n long, t string").repartition(4)
    kept = [(i, len(t.strip())) for i, t in enumerate(texts) if t and t.strip()]
    got = {r.n: r.batch for r in batching.greedy_batches(frame, "t", "n", 100, buckets=6).collect()}
    assert got == dict(zip([i for i, _ in kept], plain_batches([s for _, s in kept], 100)))
    assert batching.count_batches(frame, "t", 100, "n") == max(got.values()) + 1
    assert batching.count_batches(frame.limit(0), "t", 100, "n") == 0


# -- search -------------------------------------------------------------------


def test_knn_single_and_batch(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)).round(1)
    x[10:14] = x[9]
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "chunk_id long, embedding array<double>").repartition(3)
    near = lambda q: [int(i) for i in np.lexsort((np.arange(60), ((x - q) ** 2).sum(1).round(9)))[:5]]
    assert [r.chunk_id for r in search.knn_l2(index, x[9].tolist(), 5).collect()] == near(x[9])
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 9, 30)], "query_id long, query_vector array<double>")
    got = {}
    for r in search.knn_l2_batch(index, queries, 5).orderBy("query_id", "ord").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {i: near(x[i]) for i in (0, 9, 30)}
    assert search.knn_l2_batch(index.where("chunk_id < 2"), queries, 5).count() == 6
    assert search.knn_l2_batch(index, queries.limit(0), 5).count() == 0


def test_fusion_keeps_and_mends_the_order(spark):
    shape = "query_id long, content string, score double, ord int"
    sem = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 3.0, 2), (1, "a", 2.0, 3)], shape)
    key = spark.createDataFrame([(1, "a", 4.0, 1), (1, "c", 1.0, 2), (1, "c", 1.0, 3)], shape)
    got = [(r.content, r.score) for r in search.fuse(sem, key).orderBy("ord").collect()]
    assert got == [("a", 3.0), ("b", 1.5), ("c", 1.0)]
    near = [r.content for r in search.fuse(sem, key.limit(0), score="similarity").orderBy("ord").collect()]
    assert near == ["a", "b"]


# -- evaluation ---------------------------------------------------------------


def plain_bleu(ref, cand):
    r, c = ref.split(), cand.split()
    grams = lambda t, n: Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    total, zeros = 0.0, 0
    for n in range(1, 5):
        hits, size = sum((grams(c, n) & grams(r, n)).values()), max(1, len(c) - n + 1)
        if n == 1 and not hits:
            return 0.0
        if not hits:
            zeros += 1
            hits = math.log(len(c)) / (5 * 2**zeros) if len(c) > 1 else 0
        if hits:
            total += 0.25 * math.log(hits / size)
    return (1 if len(c) > len(r) else math.exp(1 - len(r) / len(c))) * math.exp(total)


def test_bleu(spark):
    rng = random.Random(3)
    pairs = [(" ".join(rng.choices("abcd", k=rng.randint(0, 9))), " ".join(rng.choices("abcd", k=rng.randint(0, 9)))) for _ in range(150)]
    frame = spark.createDataFrame(pairs, "r string, c string")
    for row in frame.select("r", "c", evaluation.bleu(F.col("r"), F.col("c")).alias("b")).collect():
        assert row.b == pytest.approx(plain_bleu(row.r, row.c) if row.c else 0.0, abs=1e-12)


def test_judge_and_metrics(spark):
    good = "Answer Relevance: 0.9\nAccuracy: 1\nCompleteness: 0.5\nClarity: 1.5\nSemantic Similarity Score: 80%\nExplanation: fine"
    rows = [("x y", "x y", good), ("a", "b", "Answer Relevance: 0.4 Completeness: 1.0"), ("a", "b", good.replace("80%", "85.5%")), ("a", "a", None)]
    frame = spark.createDataFrame(rows, ["ground truth", "answer", "reply"])
    got = evaluation.with_scores(frame, F.col("reply")).collect()
    names = [n for n, _ in evaluation.SCORE_LINES]
    assert [got[0][n] for n in names] == [0.9, 1.0, 0.5, 1.5, 80.0] and got[0]["Explanation"] == good
    assert [got[1][n] for n in names] == [0.4, 0, 0, 0, 0] and got[2]["Semantic Similarity"] == 0 and got[3]["Accuracy"] == 0
    scored = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 80.0), (1.0, 1.0, 1.0, 1.0, 1.0, 79.0)], [c for _, c in evaluation.METRICS])
    row = evaluation.metrics(scored).first()
    assert (row.precision, row.recall, row.f1_score, row.avg_bleu) == (1.0, 0.5, pytest.approx(2 / 3), 0.5)
    assert evaluation.metrics(scored.limit(0)).first().f1_score is None


def test_qa_pairs(spark):
    replies = [(0, '[{"question": "q", "ground_truth": "g", "ground truth": "old"},]'), (1, "nothing"), (2, '[{"question": "a ] b"}]'), (3, '[{"question": "p", "ground truth": "t", "n": "1"}]')]
    pairs = qa.qa_pairs(spark.createDataFrame(replies, "batch int, reply string"))
    assert [tuple(r) for r in qa.qa_frame(pairs).collect()] == [("q", "g"), ("p", "t")]
    assert qa.qa_pairs(spark.createDataFrame(replies, "batch int, reply string"), max_total=1).count() == 1


# -- models, rag, agents --------------------------------------------------------


def test_clients(spark, monkeypatch):
    with pytest.raises(ValueError):
        GenAIEmbeddingClient("nope")
    client = GenAIEmbeddingClient("hash")
    assert one(spark, "Étude of étude", hash_embedding) == pytest.approx(hash_vector("Étude of étude"))
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "i int, t string")
    got = {r.i: r.embedding for r in with_embedding(rows, client, "t").collect()}
    assert got[2] is None and got[1] == pytest.approx(hash_vector("a b"))
    calls, waits = [], []
    monkeypatch.setattr("time.sleep", waits.append)

    def limited(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise RuntimeError("429 slow down")
        return [[0.0]] * len(texts)

    monkeypatch.setattr(client, "_call", limited)
    assert len(client.generate_embedding(["x"] * 20)) == 20 and calls == [16, 16, 16, 4] and waits == [5.0, 10.0]
    monkeypatch.setattr(client, "_call", lambda t: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        client.generate_embedding(["x"])


def test_safe_replies(spark):
    class Failing:
        def chat(self, *_, **__):
            raise RuntimeError("down")

    rows = spark.createDataFrame([("q",), (None,)], "p string")
    got = with_reply(rows, Failing(), "p", safe=SAFE_ANSWER, error_col="e").collect()
    assert [(r.reply, r.e) for r in got] == [(SAFE_ANSWER, "down"), (None, None)]


def test_rag_end_to_end(spark, tmp_path):
    from tidemark.sources.index import VectorEmbedding, attach_index

    names = "apple river stone cloud tiger maple violin harbor candle window garden rocket".split()  # in slots of their own
    texts = [(i, f"{name} " * 8) for i, name in enumerate(names)]
    frame = spark.createDataFrame(texts, "doc_seq long, content string")
    client = GenAIEmbeddingClient("hash")
    path, chunks = VectorEmbedding(client, 60, 5).generate_index(frame, "content", str(tmp_path / "ix"))
    assert chunks.count() > 5
    chat = GenAIChatClient("stub")
    inferencer = rag.RAGInferencer(client, chat, rag.Bm25Client())
    row = inferencer.infer("s", names[7], index_path=path, top_k=2).first()
    assert names[7] in row.retrieved_docs[0] and row.answer.startswith("Context:\n") and len(row.retrieved_docs) == 2
    for mode in ("hybrid", "hyde"):
        assert inferencer.infer("s", names[7], index_path=path, mode=mode).count() == 1
    with pytest.raises(NotImplementedError):
        inferencer.infer("s", "q", index_type="databricks_vector_index", index="x", mode="hybrid")
    with pytest.raises(ValueError):
        attach_index(spark, None)
    prep = rag.RagEvalDataPrep(inferencer, "s", "local_index", path)
    questions = spark.createDataFrame([(names[1], "t"), (names[2], "u")], ["question", "ground truth"])
    answered = prep.run_rag(questions)
    assert answered.where("answer is not null").count() == 2 and prep.run_rag(questions, limit=0).count() == 0
    judge = GenAIChatClient("stub", replies={"": "Answer Relevance: 1 Accuracy: 1 Completeness: 1 Clarity: 1 Semantic Similarity Score: 90%"})
    scored, found = rag.RagEvaluator(judge, "e", str(tmp_path / "m")).evaluate(answered)
    assert scored.count() == 2 and found["f1_score"] == 1.0
    assert spark.read.parquet(str(tmp_path / "m")).first().evaluation_size == 2
    maker = rag.EvalDatasetGroundTruthGenerator(GenAIChatClient("stub", replies={names[0]: '[{"question": "q", "ground_truth": "g"}]', "": "none"}))
    assert [tuple(r) for r in maker.process_dataframe(frame, max_chars=100).collect()] == [("q", "g")]


def test_managed_upsert(spark):
    from tidemark.sources.index import UPSERT_BATCH, upsert_batches, upserted

    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, content string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, content string")
    assert sorted(map(tuple, upserted(old, new).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    batches = upsert_batches(spark.range(450)).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in batches) == [(0, UPSERT_BATCH), (1, UPSERT_BATCH), (2, 50)]


def test_agent_loop(spark):
    plans = iter(['{"tool_calls": [{"name": "add", "arguments": {"a": 1, "b": 2}}, {"name": "gone"}, {"name": "bad"}]}', '{"final_answer": 3}'])
    tools = [agents.Tool("add", "", {}, lambda a, b: a + b), agents.Tool("bad", "", {}, lambda: 1 / 0)]
    history = [{"role": "user", "content": "go"}]
    seen = []

    def told(call, result):
        seen.append(result)
        raise RuntimeError("ignored")

    assert agents.run_agent_loop(agents.JsonFunctionAdapter(lambda m: next(plans)), history, tools, on_tool_result=told) == "3"
    assert [m["content"] for m in history[1:]] == ["3", '{"error": "Unknown tool: gone"}', '{"error": "division by zero"}']
    assert seen[0] == 3
    forever = agents.JsonFunctionAdapter(lambda m: '{"tool_calls": [{"name": "x"}]}')
    assert agents.run_agent_loop(forever, [], []) == agents.OUT_OF_STEPS
    assert agents.parse_plan("plain") == ("plain", []) and agents.parse_plan("[1]") == ("[1]", [])


def test_prompts():
    assert "{context}" in prompts.Param.get_ground_truth_prompt() and "{generated_answer}" in prompts.Param.get_evaluation_prompt()

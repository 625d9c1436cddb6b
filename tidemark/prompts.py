"""Default prompts. Placeholders, keys and score lines are contracts; the wording is ours."""

from __future__ import annotations

SYSTEM = "You are a helpful assistant."

RAG = (
    "Answer the question from the context alone, briefly and exactly. "
    "If the context doesn't hold the answer, say that you don't know."
)

QA_GENERATION = (
    "Write question and answer pairs that the text below answers. Reply with a JSON array only, like\n"
    '[{{"question": "...", "ground_truth": "..."}}]\n\n'
    "Text:\n{context}"
)

HYDE = "Write a short passage that would answer this question."

EVALUATION = (
    "Compare an answer with the ground truth. Give exactly these lines, with numbers from 0 to 1 and a percentage:\n"
    "Answer Relevance: <score>\nAccuracy: <score>\nCompleteness: <score>\nClarity: <score>\nSemantic Similarity Score: <percent>%\n"
    "Explanation: <a sentence>\n\n"
    "Ground truth: {ground_truth}\nAnswer: {generated_answer}"
)


class Param:
    """Getters by name for callers that expect them."""

    @staticmethod
    def get_rag_prompt() -> str:
        return RAG

    @staticmethod
    def get_ground_truth_prompt() -> str:
        return QA_GENERATION

    @staticmethod
    def get_evaluation_prompt() -> str:
        return EVALUATION

"""Tool-calling conversations, one per row.

The loop is sequential within a conversation and independent between them, so
a frame of conversations runs in one mapInPandas, without any state across rows,
or in rounds of one step each with a journal, where tools have effects that a
lost task mustn't repeat.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ledger import Saved
from ..session import kept

#: Replies that a loop gives by itself.
OUT_OF_STEPS = "Tool execution exceeded max steps."
UNKNOWN_TOOL = "Unknown tool: {}"


@dataclass
class Tool:
    """Something a model may call. parameters is a JSON schema."""

    name: str
    description: str
    parameters: dict
    function: Callable[..., Any]


@dataclass
class ToolCall:
    id: str
    name: str
    arguments: dict = field(default_factory=dict)


class ChatAdapter(Protocol):
    def create_response(
        self,
        messages: list[dict],
        tools: list[Tool] | None = None,
        tool_choice: Any = None,
        max_tokens: int = 1024,
        temperature: float = 1.0,
    ) -> tuple[str | None, list[ToolCall]]:
        """A final answer and no calls, or None and calls."""
        ...


def _arguments(text: str | None) -> dict:
    try:
        return json.loads(text) if text is not None else {}
    except ValueError:
        return {"_raw": text}


class OpenAIStyleAdapter:
    """Native tool calls of an OpenAI-compatible client."""

    def __init__(self, client: Any, model: str):
        self.client, self.model = client, model

    def create_response(self, messages, tools=None, tool_choice=None, max_tokens=1024, temperature=1.0):
        told = [
            {"type": "function", "function": {"name": t.name, "description": t.description, "parameters": t.parameters}}
            for t in tools or []
        ]
        message = (
            self.client.chat.completions.create(
                model=self.model,
                messages=messages,
                tools=told or None,
                tool_choice=tool_choice or "auto",
                max_tokens=max_tokens,
                temperature=temperature,
            )
            .choices[0]
            .message
        )
        if calls := getattr(message, "tool_calls", None):
            return None, [ToolCall(c.id, c.function.name, _arguments(c.function.arguments)) for c in calls]
        return message.content or "", []


class JsonFunctionAdapter:
    """Tools for any chat function: the model is told to plan in JSON."""

    def __init__(self, send_chat: Callable[[list[dict]], str]):
        self.send_chat = send_chat

    def create_response(self, messages, tools=None, tool_choice=None, max_tokens=1024, temperature=1.0):
        offered = json.dumps([{"name": t.name, "description": t.description, "parameters": t.parameters} for t in tools or []])
        told = (
            f"Tools at hand: {offered}\nReply with one JSON object and nothing else: "
            '{"tool_calls": [{"name": "...", "arguments": {...}}]} to use tools, or {"final_answer": "..."} to finish.'
        )
        reply = self.send_chat([*messages, {"role": "system", "content": told}])
        return parse_plan(reply)


def parse_plan(reply: str) -> tuple[str | None, list[ToolCall]]:
    """A JSON plan's calls, numbered from 0, or its final answer; anything else is final as it stands.

    A plan is an object. Its calls are the objects in the list under tool_calls,
    numbered by their place there; a name that isn't text is empty, arguments
    that aren't an object are wrapped under _raw, missing or null ones are none.
    Without a list under tool_calls a plan has no calls and is read on.
    """
    try:
        plan = json.loads(reply)
    except (TypeError, ValueError):
        return reply, []
    if not isinstance(plan, dict):
        return reply, []
    listed = plan.get("tool_calls")
    if isinstance(listed, list):
        calls = [(i, c) for i, c in enumerate(listed) if isinstance(c, dict)]
        return None, [ToolCall(str(i), _name(c.get("name")), _wrapped(c.get("arguments"))) for i, c in calls]
    answer = plan.get("final_answer")
    if answer is not None:
        return str(answer), []
    return reply, []


def _name(given: Any) -> str:
    return given if isinstance(given, str) else ""


def _wrapped(given: Any) -> dict:
    return given if isinstance(given, dict) else {} if given is None else {"_raw": given}


def plan_columns(reply: Column) -> dict[str, Column]:
    """parse_plan() natively: final (text; answers that aren't text as JSON), and calls (array of id, name, arguments as JSON)."""
    plan = F.try_parse_json(reply)
    part = lambda v, path, kind: F.try_variant_get(v, path, kind)
    is_object = F.schema_of_variant(plan).startswith("OBJECT")
    listed = F.when(is_object, part(plan, "$.tool_calls", "array<variant>"))

    def call(c: Column, i: Column) -> Column:
        told = part(c, "$.arguments", "variant")
        text = F.to_json(told)
        # OBJECT alone may stand as it is; null is none; anything else goes under _raw
        arguments = F.when(told.isNull() | (text == "null"), "{}").when(text.startswith("{"), text)
        name = F.when(F.schema_of_variant(part(c, "$.name", "variant")) == "STRING", part(c, "$.name", "string"))
        return F.struct(
            i.cast("string").alias("id"),
            F.coalesce(name, F.lit("")).alias("name"),
            F.coalesce(arguments, F.concat(F.lit('{"_raw":'), text, F.lit("}"))).alias("arguments"),
            F.schema_of_variant(c).startswith("OBJECT").alias("ok"),
        )

    kept = F.filter(F.transform(listed, call), lambda c: c["ok"])
    calls = F.transform(kept, lambda c: F.struct(c["id"], c["name"], c["arguments"]))
    told = F.when(is_object, part(plan, "$.final_answer", "variant"))
    plain = F.to_json(told)
    answer = F.when(F.schema_of_variant(told) == "STRING", part(told, "$", "string")).when(plain != "null", plain)
    final = F.when(listed.isNull(), F.coalesce(answer, reply))
    return {"final": final, "calls": F.coalesce(calls, F.array().cast(numbered_type()))}


def numbered_type() -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "arguments")]))


def as_text(result: Any) -> str:
    """A tool's result for a message: text as it is, else JSON, else str()."""
    if isinstance(result, str):
        return result
    try:
        return json.dumps(result)
    except (TypeError, ValueError):
        return str(result)


def run_agent_loop(
    adapter: ChatAdapter,
    messages: list[dict],
    tools: list[Tool],
    max_steps: int = 8,
    on_tool_result: Callable[[str, Any], None] | None = None,
    echo_calls: bool = False,
) -> str:
    """Ask, call tools, tell, until a final answer or max_steps.

    Results are appended to messages. Unknown tools and failing ones give an
    error as their result; a failing callback is passed over; of tools of one
    name the last wins. echo_calls also appends the assistant's turn, which
    strict providers ask for.
    """
    for _ in range(max_steps):
        final = agent_step(adapter, messages, tools, on_tool_result, echo_calls)
        if final is not None:
            return final
    return OUT_OF_STEPS


def agent_step(
    adapter: ChatAdapter,
    messages: list[dict],
    tools: list[Tool],
    on_tool_result: Callable[[str, Any], None] | None = None,
    echo_calls: bool = False,
    once: Callable[[str, Callable[[], Any]], Any] = lambda _, make: make(),
) -> str | None:
    """One question to the model: its final answer, or None when its tool calls' results are among messages.

    once(name, make) gives what make gives; it may remember it by name, the
    model's reply as "reply" and each call's result by its number.
    """

    def ask() -> list:
        final, calls = adapter.create_response(messages, tools=tools)
        return [final, [[c.id, c.name, c.arguments] for c in calls]]

    by_name = {t.name: t for t in tools}
    final, listed = once("reply", ask)
    if final is not None:
        return final
    calls = [ToolCall(*c) for c in listed]
    if echo_calls and calls:
        told = [{"id": c.id, "type": "function", "function": {"name": c.name, "arguments": json.dumps(c.arguments)}} for c in calls]
        messages.append({"role": "assistant", "content": "", "tool_calls": told})
    for number, call in enumerate(calls):

        def run(call: ToolCall = call) -> str:
            tool = by_name.get(call.name)
            try:
                result = tool.function(**call.arguments) if tool else {"error": UNKNOWN_TOOL.format(call.name)}
            except Exception as e:
                result = {"error": str(e)}
            if on_tool_result:
                try:
                    on_tool_result(call.name, result)
                except Exception:
                    pass
            return as_text(result)

        messages.append({"role": "tool", "name": call.name, "tool_call_id": call.id, "content": once(str(number), run)})
    return None


MESSAGES = "array<struct<role:string,content:string,name:string,tool_call_id:string>>"


def run_agents(
    conversations: DataFrame,
    make_adapter: Callable[[], ChatAdapter],
    tools: list[Tool],
    max_steps: int = 8,
    messages_col: str = "messages",
    id_col: str = "conv_id",
) -> DataFrame:
    """(id_col, answer, messages) for conversations of (id_col, messages). make_adapter is called once per task."""
    kind = conversations.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        adapter = make_adapter()
        for batch in batches:
            answers, histories = [], []
            for given in batch[messages_col]:
                history = [{k: v for k, v in dict(m).items() if v is not None} for m in (given if given is not None else [])]
                answers.append(run_agent_loop(adapter, history, tools, max_steps))
                histories.append([{k: m.get(k) for k in ("role", "content", "name", "tool_call_id")} for m in history])
            yield pd.DataFrame({id_col: batch[id_col], "answer": answers, "messages": histories})

    rows = conversations.select(id_col, messages_col)
    return rows.mapInPandas(run, f"{id_col} {kind}, answer string, messages {MESSAGES}")


def run_agents_in_rounds(
    conversations: DataFrame,
    make_adapter: Callable[[], ChatAdapter],
    tools: list[Tool],
    journal: str,
    max_steps: int = 8,
    messages_col: str = "messages",
    id_col: str = "conv_id",
) -> DataFrame:
    """As run_agents(), a step of all open conversations at a time, with a journal that lets a broken job go on.

    Each round writes its conversations' state; finished ones leave. Model
    replies and tool results are saved in the journal folder as they come, so a
    task that is run again, or a job that is started again with the same
    journal, repeats neither calls nor a tool's effects (but for one that was
    lost between its effect and its file). Ids tell conversations apart and
    aren't null. A journal belongs to one set of conversations, tools and model.
    """
    kind = conversations.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, answer string, messages {MESSAGES}"
    state = kept(conversations.select(id_col, F.lit(None).cast("string").alias("answer"), F.col(messages_col).cast(MESSAGES).alias("messages")))
    done: list[DataFrame] = []

    def step_of(number: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            adapter, saved = make_adapter(), Saved(journal)
            for batch in batches:
                answers, histories = [], []
                for name, given in zip(batch[id_col], batch["messages"]):
                    history = [{k: v for k, v in dict(m).items() if v is not None} for m in (given if given is not None else [])]
                    key = lambda part: hashlib.sha256(f"{number}|{part}|{name}".encode()).hexdigest()
                    answers.append(agent_step(adapter, history, tools, once=lambda part, make: saved.get(key(part), make)))
                    histories.append([{k: m.get(k) for k in ("role", "content", "name", "tool_call_id")} for m in history])
                yield pd.DataFrame({id_col: batch[id_col], "answer": answers, "messages": histories})

        return step

    for number in range(max_steps):
        stepped = kept(state.mapInPandas(step_of(number), schema))
        done.append(stepped.where(F.col("answer").isNotNull()))
        state = stepped.where(F.col("answer").isNull())
        if not state.take(1):
            break
    left = state.withColumn("answer", F.lit(OUT_OF_STEPS))
    return reduce(DataFrame.unionByName, done, left)

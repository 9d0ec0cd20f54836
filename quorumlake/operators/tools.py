"""Tools that a model may call over the tables, their dispatch, and the loop that lets it call them."""

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Steps that a run takes at most.
MOST_ITERATIONS = 15


@dataclass
class Toolbox:
    """search_topics, get_meeting_digest and find_meetings_with_topics over a table of meetings; errors become results."""

    meetings: DataFrame
    municipality: str | None = None

    def call(self, name: str, args: dict | None) -> dict:
        from ..plans import search

        a = args or {}
        code = a.get("municipality_code") or self.municipality
        rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]  # noqa: E731  a page of at most 100 rows
        try:
            if name == "search_topics":
                return {"rows": rows(search.search_topics(self.meetings, str(a.get("query", "")), code, a.get("date_from"), a.get("date_to"), a.get("limit") or 30))}
            if name == "get_meeting_digest":
                found = rows(search.meeting_digest(self.meetings, str(a.get("meeting_id"))))
                return found[0] if found else {"error": "not found"}
            if name == "find_meetings_with_topics":
                return {"rows": rows(search.meetings_with_topics(self.meetings, a.get("topics") or [], code=code, limit=a.get("limit") or 20))}
            return {"error": f"unknown function: {name}"}
        except Exception as e:  # noqa: BLE001  the model sees the error and may try otherwise
            return {"error": str(e)}


@dataclass
class Run:
    """What a run did: (index, call, kind, name, args, result, text) for each step, tokens, and why it ended."""

    steps: list[tuple] = field(default_factory=list)
    input_tokens: int = 0
    output_tokens: int = 0
    calls: int = 0
    end_reason: str = "max_iterations"
    answer: str | None = None


def ask(question: str, model: Callable[[list[dict]], dict], tools: Toolbox, most: int = MOST_ITERATIONS) -> Run:
    """Lets a model answer: model(messages) returns {text or calls: [(name, args)], input_tokens, output_tokens}; it is called until it gives a text, `most` times at most."""
    run, messages = Run(), [{"role": "user", "text": question}]
    for index in range(1, most + 1):
        reply = model(messages)
        run.calls += 1
        run.input_tokens += reply.get("input_tokens", 0)
        run.output_tokens += reply.get("output_tokens", 0)
        if not reply.get("calls"):
            run.answer, run.end_reason = reply.get("text", ""), "final_answer"
            run.steps.append((index, 0, "final", None, None, None, run.answer))
            return run
        for n, (name, args) in enumerate(reply["calls"]):
            result = tools.call(name, args)
            run.steps.append((index, n, "tool", name, json.dumps(args, ensure_ascii=False), json.dumps(result, ensure_ascii=False, default=str), None))
            messages.append({"role": "tool", "name": name, "args": args, "result": result})
    return run

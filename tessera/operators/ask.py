"""Questions made of sub-questions: their order by dependency, coverage, and the run as a whole.

A question has a handful of sub-questions, so this is driver code around distributed retrieval.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from ..models import Chat

SUBGOALS, GAPS, MEMORY, COVERED, UNCOVERED, REFINE_BELOW = 5, 3, 3, 0.6, 0.2, 0.5

# What tells the kind of a question.
MODES = [
    ("set", ["сколько", "how many", "list all", "перечисли все", "number of"]),
    ("global", ["главные тем", "основные тем", "обзор", "какие тем", "какие направления", "список тем", "все темы", "overview", "main themes", "key themes", "what topics"]),
    ("local", ["что конкретно", "как работает", "как устроен", "как устроена", "что такое", "что делает", "подробно", "детали", "в чем разница", "разница между", "compare", "details", "specifically", "how does", "what does", "explain"]),
]


def select_mode(query: str) -> str:
    q = query.strip().lower()
    return next((m for m, words in MODES if any(w in q for w in words)), "drift")


def clean_dependencies(ids: Sequence[str], deps: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Dependencies that exist, on others, each once; edges that close a cycle go, in the order of ids."""
    known = set(ids)
    out: dict[str, list[str]] = {i: [] for i in ids}

    def reaches(a: str, b: str) -> bool:
        todo, seen = [a], set()
        while todo:
            x = todo.pop()
            if x == b:
                return True
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return False

    for i in sorted(ids):
        for d in dict.fromkeys(deps.get(i, ())):
            if d in known and d != i and not reaches(d, i):
                out[i].append(d)
    return out


def levels(ids: Sequence[str], deps: dict[str, Sequence[str]]) -> dict[str, int]:
    """Each question's longest path to one without dependencies."""
    clean = clean_dependencies(ids, deps)
    out: dict[str, int] = {}

    def level(i: str) -> int:
        if i not in out:
            out[i] = max((level(d) + 1 for d in clean[i]), default=0)
        return out[i]

    for i in ids:
        level(i)
    return out


def waves(ids: Sequence[str], deps: dict[str, Sequence[str]]) -> list[list[str]]:
    """Questions by level, each level's in order; a level may run at once after the ones before."""
    at = levels(ids, deps)
    return [sorted(i for i in ids if at[i] == n) for n in range(max(at.values(), default=-1) + 1)]


def coverage(scores: Sequence[float], k: int) -> float:
    """Half how many of k results there are, half their mean score."""
    if not scores:
        return 0.0
    mean = min(max(sum(scores) / len(scores), 0.0), 1.0)
    return (min(len(scores) / max(k, 1), 1.0) + mean) / 2


@dataclass
class Node:
    id: str
    query: str
    mode: str
    depends_on: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    answer: str = ""
    coverage: float = 0.0


@dataclass
class Answer:
    nodes: list[Node]
    text: str
    abstained: bool
    refined: bool
    degraded: list[str]


def _json(text: str) -> object:
    body = re.sub(r"(?s)^```[a-zA-Z]*\s*|\s*```$", "", text.strip())
    return json.loads(re.sub(r",(\s*[}\]])", r"\1", body))


def decompose(query: str, chat: Chat) -> list[Node]:
    """Sub-questions with dependencies, five at most; the question itself where the model gives none."""
    try:
        raw = _json(chat.chat("Decompose the question into sub-questions as a JSON list of {query, depends_on}.", query))
        items = [(x["query"].strip(), [str(d) for d in x.get("depends_on") or ()]) for x in raw if str(x.get("query", "")).strip()][:SUBGOALS]
    except (ValueError, TypeError, KeyError, AttributeError):
        items = []
    if not items:
        items = [(query, [])]
    ids = [str(i) for i in range(len(items))]
    clean = clean_dependencies(ids, {i: d for i, (_, d) in zip(ids, items, strict=True)})
    return [Node(i, q, select_mode(q), clean[i]) for i, (q, _) in zip(ids, items, strict=True)]


Retrieve = Callable[[str, str], list[tuple[str, str, float]]]


def ask(query: str, retrieve: Retrieve, chat: Chat, k: int = 8, cache: dict | None = None, key: str | None = None) -> Answer:
    """The answer to a question: sub-questions in waves, then at most one pass over gaps, then one text.

    retrieve(query, mode) gives (id, text, score) of at most k chunks. Model failures degrade the answer
    and are listed; they do not end it. A cached answer of the key comes back as it was.
    """
    if cache is not None and key in cache:
        return cache[key]
    degraded: list[str] = []
    nodes = decompose(query, chat)
    memory: deque[str] = deque(maxlen=MEMORY)

    def resolve(n: Node, done: dict[str, Node]) -> None:
        found = retrieve(n.query, n.mode)[:k]
        n.sources = [f[0] for f in found]
        n.coverage = coverage([f[2] for f in found], k)
        if UNCOVERED < n.coverage < COVERED:
            try:
                n.coverage = min(max(float(_json(chat.chat("Judge how far the context answers the question, as JSON {score}.", n.query))["score"]), 0.0), 1.0)
            except (ValueError, TypeError, KeyError):
                degraded.append(f"coverage of {n.id}")
        context = [done[d].answer for d in n.depends_on if d in done] or list(memory)
        prompt = "\n\n".join([n.query, *context, *(f"[{i}] {t}" for i, t, _ in found)])
        n.answer = chat.chat("Answer from the context with citations.", prompt) or "; ".join(t[:200] for _, t, _ in found[:3])
        if not n.depends_on:
            memory.append(n.answer)

    def run(batch: list[Node]) -> None:
        by = {n.id: n for n in nodes}
        for wave in waves([n.id for n in batch], {n.id: n.depends_on for n in batch}):
            for i in wave:
                resolve(by[i], by)

    run(nodes)
    mean = sum(n.coverage for n in nodes) / len(nodes)
    refined = False
    if mean < REFINE_BELOW:
        try:
            gaps = [str(g).strip() for g in _json(chat.chat("Name the gaps in these answers as a JSON list of questions.", "\n".join(n.answer for n in nodes))) if str(g).strip()][:GAPS]
        except (ValueError, TypeError):
            gaps = []
        if gaps:
            more = [Node(f"gap-{i}", g, select_mode(g)) for i, g in enumerate(gaps)]
            nodes += more
            run(more)
            refined = True
    abstained = all(n.coverage <= UNCOVERED for n in nodes)
    text = "The knowledge base does not contain the information needed to answer." if abstained else chat.chat("Combine the answers.", "\n\n".join(n.answer for n in nodes)) or "\n\n".join(n.answer for n in nodes)
    out = Answer(nodes, text, abstained, refined, degraded)
    if cache is not None and key is not None:
        cache[key] = out
    return out

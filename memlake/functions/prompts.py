"""Prompts for the model seams, as text; what they ask for is what seams.FACTS and reconcile.by_ordinal read."""

from __future__ import annotations

_SHAPE = 'Answer with JSON only: {"memories": [{"l0_abstract": one line, "l1_overview": a paragraph, "l2_content": all details, "category": profile | preferences | entities | events | cases | patterns, "tags": [words]}]}'


def extraction(messages: str, context: str | None = None) -> tuple[str, str]:
    """(system, user) that ask for the facts of a conversation."""
    about = f" The conversation is about: {context}." if context else ""
    return f"Extract what is worth remembering about the user from a conversation: stated facts, preferences, events, solved cases. Leave out greetings and guesses.{about} {_SHAPE}", f"Conversation:\n{messages}"


def section(text: str) -> tuple[str, str]:
    return f"Extract the facts that a section of a document states; each must stand alone. {_SHAPE}", f"Section:\n{text}"


def document(text: str) -> tuple[str, str]:
    return f"Extract one memory that sums up a short document. {_SHAPE}", f"Document:\n{text}"


def batch_dedup(facts: list[str]) -> tuple[str, str]:
    """Asks which of numbered facts to keep."""
    return 'Some of these facts say the same. Answer with JSON only: {"keep_indices": [numbers of the facts to keep]}', "\n".join(f"{i}. {f}" for i, f in enumerate(facts))


def reconciliation(facts: list[str], existing: list[tuple[int, str, str]]) -> tuple[str, str]:
    """Asks for a decision about each numbered fact, given existing memories (ordinal, age, text)."""
    system = 'For each fact decide, against the existing memories: CREATE, MERGE, SKIP, SUPERSEDE, SUPPORT, CONTEXTUALIZE or CONTRADICT. Answer with JSON only: {"decisions": [{"action", "fact_index", "match_index", "merged_content", "context_label", "reason"}]}'
    return system, "Facts:\n" + "\n".join(f"{i}. {f}" for i, f in enumerate(facts)) + "\n\nExisting memories:\n" + "\n".join(f"{i}. ({age}) {t}" for i, age, t in existing)

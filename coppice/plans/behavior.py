"""How an evaluation treats its input and its output across ranks (contiguous parts of the work)."""

from __future__ import annotations

from enum import IntFlag


class Behavior(IntFlag):
    # Fixed values.
    DEFAULT = 0
    GATHER_INPUT = 0x01  # the rows that base cases (and processed inner nodes) were made of come back as well
    REPLICATED_INPUT = 0x02  # every rank holds the whole input
    REPLICATE_INPUT = 0x04  # the input is sent to every rank first
    REPLICATE_OUTPUT = 0x08  # every rank gets the result
    DISTRIBUTED_INPUT = 0x10  # each rank has a part of the input of its own
    DISTRIBUTED_OUTPUT = 0x20  # each rank keeps its own result; nothing is combined
    PRIORITIZE_DM = 0x40  # ranks are dealt and combined level by level
    SCATTER = 0x80  # ranks get contiguous ranges of the input's positions
    GATHER = 0x100  # results come back in the order of ranks
    BALANCE = 0x200  # the tree is split until ranks hold like numbers of sub-problems
    REUSABLE_GATHER = 0x400  # a gather whose layout is kept for the next evaluation
    USE_COST = 0x800  # balance by the problem's cost instead of by number
    SAFE_LOAD = 0x1000  # rows are immutable: nothing to do
    KEEP_INPUT = 0x2000  # inputs are never changed in place: nothing to do


def resolve(behavior: Behavior, returns: bool = True, arity: int = 0) -> Behavior:
    """`behavior` with what it implies; contradictions raise.  `returns`: whether the body has a result."""
    b = Behavior(behavior)
    if b & Behavior.REPLICATE_INPUT:
        b |= Behavior.REPLICATED_INPUT
    if b & Behavior.REUSABLE_GATHER:
        b |= Behavior.GATHER
    if b & Behavior.USE_COST:
        b |= Behavior.BALANCE
    if not returns and not b & Behavior.DISTRIBUTED_OUTPUT:
        b |= Behavior.GATHER_INPUT
    if b & Behavior.DISTRIBUTED_INPUT and b & Behavior.REPLICATED_INPUT:
        raise ValueError("an input is either replicated or distributed")
    if b & Behavior.PRIORITIZE_DM and b & Behavior.SCATTER:
        raise ValueError("ranks are dealt either level by level or as contiguous ranges")
    if b & Behavior.PRIORITIZE_DM and not arity:
        raise ValueError("dealing level by level needs a fixed arity")
    if b & Behavior.DISTRIBUTED_OUTPUT and b & Behavior.REPLICATE_OUTPUT:
        raise ValueError("an output is either distributed or replicated")
    return b


def all_gathers(b: Behavior) -> bool:
    """Whether every rank gets all ranks' results, in order."""
    return bool(b & Behavior.GATHER and b & Behavior.REPLICATE_OUTPUT and b & Behavior.REPLICATED_INPUT and not b & Behavior.GATHER_INPUT)

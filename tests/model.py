"""A plain model of the rules, for one chat at a time, that the plans are checked against."""

from __future__ import annotations

import random

SIZES = {  # prefix, frame, extra for a reply, block shown for an empty preamble, title words
    "plain": (1, 3, 0, False, 0),
    "sectioned": (1, 3, 0, False, 3),
    "marked": (1, 3, 2, True, 0),
}


def valid(messages: list[tuple[str, str]]) -> bool:
    roles = [r for r, _ in messages]
    if any(r not in ("System", "User", "Chatbot") for r in roles) or "Chatbot" not in roles:
        return False
    opening = 1 if roles[0] == "System" else 0
    waiting = 0
    for r in roles[opening:]:
        if r == "Chatbot" and not waiting:
            return False
        waiting = 0 if r == "Chatbot" else waiting + 1
    return True


def turns_of(messages):
    preamble, body = "", list(messages)
    if body and body[0][0] == "System":
        preamble, body = body[0][1], body[1:]
    turns, current = [], []
    for m in body:
        current.append(m)
        if m[0] == "Chatbot":
            turns.append(current)
            current = []
    return preamble, turns


def cost(profile, turn):
    _, frame, extra, _, _ = SIZES[profile]
    return sum(frame + len(t.split()) + (extra if r == "Chatbot" else 0) for r, t in turn if t)


def base(profile, preamble):
    prefix, frame, _, always, title = SIZES[profile]
    return prefix + (frame + title + len(preamble.split()) if preamble or always else 0)


def contexts(profile, messages, budget, mode):
    """``[(turn, first turn of its context, tokens)]``."""
    preamble, turns = turns_of(messages)
    b, empty = base(profile, preamble), base(profile, "")
    held, out = [], []
    for i, turn in enumerate(turns):
        c = cost(profile, turn)
        if c == 0 or b + c > budget:
            continue
        held = held + [(i, c)]
        size = b + sum(x for _, x in held)
        counted = size
        while counted > budget:
            counted -= held[0][1] + (empty if mode == "reference" else 0)
            held = held[1:]
        out.append((i, held[0][0], b + sum(x for _, x in held)))
    return out


def random_chat(rng: random.Random, longest: int = 24):
    n = rng.randint(1, longest)
    chat = []
    if rng.random() < 0.4:
        chat.append(("System", " ".join(["rule"] * rng.choice([0, 1, 3]))))
    while len(chat) < n:
        role = rng.choices(["User", "System", "Chatbot"], [4, 1, 4])[0]
        chat.append((role, " ".join(["w"] * rng.choice([0, 1, 1, 2, 3, 5, 8, 30]))))
    return chat

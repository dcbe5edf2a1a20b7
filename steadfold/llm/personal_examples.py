"""A small labelled table for the field of ``personal_data``: sentences that are made by rule from a seed.

Each sentence has words around a value.  A value is personal data in one of its
notations, which gives a span, or a number or sign that only looks like it.
"""

from __future__ import annotations

import random

_SYLLABLES = "an ber ción de en er es ge ho in ka la li men ne on ou qu ra re se st ti to un ver".split()
#: Words before a value, and those that come before and after others, in several languages.
_CUES = ("call", "phone:", "tel.", "Tel:", "mail", "e-mail:", "contact", "write to", "card", "Karte:", "IP", "host", "server", "from", "by", "und", "y", "et", "or", "a", "de", "")
_NAMES = ("jane", "John.Smith", "info", "m.keller", "a_lopez", "contact-us", "sales", "peter99", "42", "no.reply")
_HOSTS = ("example", "mail7.example", "corp-net", "uni-ulm", "box.server", "acme")
_TOPS = ("com", "org", "net", "de", "fr", "es", "edu", "io")


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _word(rng: random.Random) -> str:
    word = "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))
    return rng.choice((word, word, word, word.capitalize(), word.upper()))


def _email(rng: random.Random) -> str:
    at = rng.choice(("@", "@", " @ ", " [at] ", "[at]", " (at) ", "(at)", " at ", " AT ", " <at> ", " {at} ", " arroba ", " [arobase] "))
    dot = "." if at == "@" else rng.choice((".", " . ", " dot ", " DOT ", " [dot] ", "[dot]", "(dot)", " (dot) ", "[.]", " punto ", " point ", " punkt "))
    if at.strip() in ("at", "AT") and "." in dot:
        dot = " dot "
    return f"{rng.choice(_NAMES)}{at}{rng.choice(_HOSTS)}.{rng.choice(_TOPS)}".replace(".", dot) if at != "@" else f"{rng.choice(_NAMES)}@{rng.choice(_HOSTS)}.{rng.choice(_TOPS)}"


def _ip(rng: random.Random) -> str:
    return rng.choice((".", ".", " . ", "[.]", "(.)", " dot ", " [dot] ", "[dot]", ". ")).join(str(rng.randint(0, 255)) for _ in range(4))


def _card(rng: random.Random) -> str:
    sizes, sep = rng.choice((((4, 4, 4, 4), None), ((4, 4, 4, 4), None), ((4, 6, 5), None), ((4, 4, 4, 4), ""), ((4, 6, 5), ""))), None
    sep = rng.choice((" ", "-", ".", "/", "_", " - ", "  ")) if sizes[1] is None else ""
    n = sum(sizes[0])
    body = rng.choice("3456") + _digits(rng, n - 2)
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(body)))
    body += str(-total % 10)
    parts, at = [], 0
    for size in sizes[0]:
        parts.append(body[at : at + size])
        at += size
    return sep.join(parts)


def _phone(rng: random.Random) -> str:
    a, b, c = str(rng.randint(200, 999)), _digits(rng, 3), _digits(rng, 4)
    two = [_digits(rng, 2) for _ in range(4)]
    return rng.choice((
        f"+1 ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b}{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a} {b}-{c}", f"1-{a}-{b}-{c}",
        f"001 {a} {b} {c}", f"00{rng.randint(30, 49)} {rng.randint(10, 99)} {b}{c}", f"0{rng.randint(1, 9)} {' '.join(two)}", f"0{rng.randint(1, 9)}.{'.'.join(two)}", f"0{rng.randint(20, 99)}/{b}{c}", f"0{rng.randint(20, 99)} - {b}{c}",
    ))


def _other(rng: random.Random) -> str:
    """What looks like personal data and isn't."""
    n = rng.randint
    hexed = "".join(rng.choices("0123456789abcdef", k=32))
    return rng.choice((
        f"{n(1, 9)}.{n(0, 20)}", f"v{n(1, 9)}.{n(0, 20)}.{n(0, 9)}", f"{n(1, 9)}.{n(0, 9)}.", f"{n(0, 23)}:{_digits(rng, 2)}", f"{n(1, 28)}.{n(1, 12)}.{n(1950, 2030)}", f"{n(1950, 2030)}-{n(10, 12)}-{n(10, 28)}", f"{n(1, 12)}/{n(1, 28)}/{n(1950, 2030)}",
        f"{n(1950, 2030)}", f"({n(1950, 2030)})", f"{n(1950, 2030)}-{n(1950, 2030)}", f"pp. {n(1, 999)}-{n(1, 999)}", f"{n(1, 999)},{_digits(rng, 3)}", f"${n(1, 999)}.{_digits(rng, 2)}", f"{n(1, 99)} %", f"no. {_digits(rng, n(1, 9))}", f"#{_digits(rng, n(1, 9))}",
        f'token = "{hexed}"', f'key="{hexed[:20]}"', hexed, f"token: {hexed.upper()}", f"{n(1, 99)} {_word(rng)} {n(1, 999)} {_word(rng)}", f"{n(1, 9)} {n(1, 9)} {n(1, 9)} {n(1, 9)}", f"{_digits(rng, n(1, 9))} {_digits(rng, 2)}", f"{n(1, 9)}) {_word(rng)}",
        f"{_word(rng)} at {_word(rng)}", f"at the {_word(rng)}.", f"{_word(rng)} at {_word(rng)}. {_word(rng)}", f"dot {_word(rng)}", f"{_word(rng)} point {_word(rng)}", f"point {n(1, 9)}.", f"punto. {_word(rng)}", f"@{_word(rng)}", f"{_word(rng)} @ {_word(rng)}", f"{n(1, 99)} @ {n(1, 99)}",
        f"{n(1, 99)}x{n(1, 99)}", f"{n(1, 99)}-{n(1, 99)}", f"a{n(1, 999)}b{n(1, 99)}", f"{n(1000, 99999)}", f"{_digits(rng, 5)}-{_digits(rng, 4)}", f"{n(1, 9)}.{n(1, 9)}.{n(1, 9)} {_word(rng)}", f"{n(256, 999)}.{n(256, 999)}.{n(1, 999)}.{n(256, 999)}", f"{_digits(rng, 12)}", f"{_digits(rng, 20)}",
    ))


_MAKERS = (_email, _ip, _card, _phone)


def examples(rows: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, spans) of so many sentences; a span is the number of its kind (email, ip, card, phone), start and end."""
    rng, out = random.Random(seed), []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join(_word(rng) for _ in range(rng.randint(0, 5))) + rng.choice((" ", " ", ", ", ". ", ": ", " | "))
            kind = rng.choice((0, 1, 2, 3, None, None, None))
            if kind is None:
                text += _other(rng)
            else:
                cue = rng.choice(_CUES)
                text += cue + " " * bool(cue)
                value = _MAKERS[kind](rng)
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            text += rng.choice(("", "", ".", ",", "!!", ")", "###", ";", "\n", " |", "%%%")) + " "
        out.append((text + " ".join(_word(rng) for _ in range(rng.randint(0, 5))), spans))
    return out

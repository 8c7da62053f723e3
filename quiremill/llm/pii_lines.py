"""The small labelled table that the field of ``pii`` is trained on: lines written by hand, and lines by rule."""

from __future__ import annotations

import hashlib
import random
import re

#: Words that carry a hint, by group (fixed values).
HINTS = {
    "at": ("at",),
    "dot": ("dot",),
    "mail": ("mail", "email", "contact", "write", "address"),
    "call": ("phone", "tel", "telephone", "call", "fax", "mobile", "cell", "dial", "ring"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "pan"),
    "host": ("ip", "host", "server", "ping", "ipv4"),
    "top": ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info"),
    "not": ("version", "order", "invoice", "isbn", "id", "ref", "page", "password", "token", "key", "total", "on", "year", "section"),
}

#: Lines by hand; personal data stands as {kind:text}.
BY_HAND = (
    "Please write to {email:anna.berg at posteo dot de} before Friday.",
    "my address is {email:j_miller (at) example.org}, the old one is gone",
    "reach us under {email:office[at]harbour[dot]net} or by post",
    "mail {email:kim at mail.org} for the slides",
    "Contact: {email:r.diaz at correo.es}; office hours are nine to five",
    "{email:the.long.way.home@sub.example dot com} is what she typed",
    "schreib an {email:peter.lang (at) firma.de} wegen der Rechnung",
    "pour toute question: {email:service at mairie dot fr}",
    "escribe a {email:maria.lopez at servicio.es} hoy",
    "e-mail {email:first.last.of.the.whole.family at example dot org} now",
    "Send the form to {email:hr @ bigco.com} and keep a copy",
    "We arrive at noon. Then we eat.",
    "She laughed at him. Nobody else did.",
    "look at home.html for the source",
    "they met at dawn, at the dot of nine",
    "Put a dot at the end. Org charts come later.",
    "he stayed at home. Com is short for communication",
    "at last. At the end of the road stood an old mill",
    "a dot and a dash make a letter",
    "sie warten at work. De Gaulle spoke next",
    "Look at me. In the end all was well.",
    "the price at market.close was lower than expected",
    "call me at noon. Info follows.",
    "at 10.30 the train leaves",
    "prices start at 4.99 and end at 19.99",
    "Call {phone:(555) 123-4567} after six.",
    "tel {phone:030-555-1234} or come by",
    "phone: {phone:555.867.5309}, ask for Jo",
    "Rückruf unter {phone:0049 30 5551234} erbeten",
    "fax {phone:+44 (20) 794-6018} is out of use",
    "mobile {phone:(212) 555-0187}; do not ring twice",
    "the years 1914-1918 and 1939-1945",
    "room 120-345, second floor",
    "part no. 555-0199-22 is out of stock",
    "ISBN 978-3-16-148410-0 is a book",
    "from 100 to 200 and from 300 to 400",
    "score 3-2 after 90 minutes",
    "section 12.3.4 of the report",
    "version 10.2.33 came out in 2019",
    "on 12.03.2014 at 14:05:33",
    "2021-04-05 2021-04-06 2021-04-07",
    "order 1234567890 was shipped",
    "host {ip:10 . 0 . 0 . 12} does not answer",
    "ping {ip:192[.]168[.]1[.]20} first",
    "the server {ip:172[.]16[.]254[.]1} was seen in the log",
    "blocked {ip:8[.]8[.]4[.]4} again",
    "card {card:4111.1111.1111.1111} was declined",
    "visa {card:4012/8888/8888/1881}, valid to 09/27",
    "pay with {card:5555.5555.5555.4444} today",
    "amex {card:3782.8224.6310.005} on file",
    "the number 1234.5678.9012.3456 is no card",
    "values 1.5 2.5 3.5 4.5 in the table",
    "a total of 1,234,567.89 was paid",
    "see pages 12, 13, 14 and 15",
    "GPS 52.5200 13.4050 is Berlin",
    "password=9f8e7d6c5b4a is not safe",
    "Copyright 2004-2019 by the authors. All rights reserved.",
    "the [.] key and the (at) sign are hard to find",
    "v = (a.b) . c . d and so on",
    "one two three four five six seven eight nine ten",
    "Der Rat tagt um 10.15 Uhr in Saal 3.",
    "la réunion est à 14 h 30, salle 12",
    "el tren sale a las 10.45 del andén 3",
)


def _luhn(digits: str) -> bool:
    each = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in each) % 10 == 0


def by_hand() -> list[tuple[str, list[tuple[str, int, int]]]]:
    out = []
    for line in BY_HAND:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(\w+):([^}]*)\}", line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out


def by_rule(count: int = 900, seed: int = 3) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines of filler words with personal data and look-alikes."""
    r, kinds = random.Random(seed), ("email", "ip", "card", "phone")

    def word(a: int = 2, b: int = 9) -> str:
        w = "".join(r.choice("aeioubcdfghklmnprstvwy") for _ in range(r.randint(a, b)))
        return r.choice((w, w, w, w, w, w.title(), w.title(), w.upper()))

    def digits(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = r.choice("3456") + digits(r.choice((11, 14, 14, 14, 17)))
        number = body + next(c for c in "0123456789" if _luhn(body + c))
        sep = r.choice(("", "", " ", "-", ".", "/"))
        return sep.join(number[k : k + 4] for k in range(0, len(number), 4))

    def phone() -> str:
        area, first, last = digits(3), digits(3), digits(4)
        return r.choice((f"+{digits(1)} ({area}) {first}-{last}", f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", f"+{digits(2)} {area} {first} {last}", f"00{digits(2)} {area} {first}{last}"))

    def ip() -> str:
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        return r.choice((".", ".", " . ", "[.]")).join(parts)

    def email() -> str:
        user, host, top = word().lower() + r.choice(("", "." + digits(2), "_" + word().lower())), word().lower(), r.choice(HINTS["top"])
        return r.choice((f"{user}@{host}.{top}", f"{user} at {host} dot {top}", f"{user} @ {host}.{top}", f"{user}(at){host}.{top}", f"{user} [at] {host} [dot] {top}", f"{user}@{host} dot {top}", f"{user} at {host}.{top}"))

    def other() -> str:
        return r.choice((digits(4), f"{digits(2)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"${digits(3)}", f"{digits(3)},{digits(3)}", hashlib.md5(digits(9).encode()).hexdigest(), f"password={hashlib.md5(digits(9).encode()).hexdigest()[:18]}", f"invoice {digits(8)}", f"order {digits(10)}", "".join(r.choice("#*~^%&{}|<>!?;$=_'\"") for _ in range(r.randint(1, 9))), word().upper(), word().upper(), f"{word().title()}{word().upper()}{digits(1)}", f"at {word()} dot", f"at {word()}. {word()}", f"{word()} at {word()}. {word()}", f"{word()}. {word().title()}", f"at {word()}, {word()}", f"{digits(2)}%", f"{word()}@", f"page {digits(3)}", f"{digits(2)} {word()} {digits(2)}", f"{digits(3)} {digits(3)}", digits(22), f"({digits(4)})", f"{digits(2)}/{digits(2)}/{digits(4)}"))

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    hint = {"email": "mail", "ip": "host", "card": "card", "phone": "call"}
    rows = []
    for _ in range(count):
        line, spans = " ".join(word() for _ in range(r.randint(0, 5))), []
        for _ in range(r.randint(1, 2)):
            kind = r.choice((*kinds, "", "", ""))
            line += r.choice((" ", " ", ", ", ". ", "\n")) if line else ""
            if kind and r.random() < 0.4:
                line += r.choice(HINTS[hint[kind]]) + r.choice((" ", ": ", " is "))
            item = make[kind]() if kind else other()
            if kind:
                spans.append((kind, len(line), len(line) + len(item)))
            line += item + r.choice(("", ".", ",", "")) + " " + " ".join(word() for _ in range(r.randint(0, 4)))
        rows.append((line, spans))
    return rows

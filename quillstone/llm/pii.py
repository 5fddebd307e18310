"""Personal data: plain identifiers, and disguised ones found through offset-preserving transducers.

Plain (base) identifiers are matched leftmost and without overlap for each kind: e-mail addresses, IPv4
addresses, card numbers (Luhn) and phone numbers.

Disguises are undone by two transducers whose every output character knows the source characters it
stands for. The first maps homoglyphs (full-width and look-alike letters, digits of other scripts) one
to one. The second is a deterministic machine over a trie of rewrites, longest match first: at and dot
in brackets or as words, character references, spelled digits with their separators, a spelled plus,
zero-width characters. Identifiers are then matched in the normalised text and their spans mapped back;
one counts if a rewritten character is inside and no base span of its kind overlaps it. A bare word
"at" makes an e-mail address only together with a spelled dot, so "meet at example.com" is none.

Defined cases: a null text counts as empty and has no spans; repeated rows are judged alike; an empty
table gives an empty result; texts of any length are scanned whole, in linear time; rewrites of spelled digits and of at and
dot know English words only; other columns are ignored, whatever their names, and a kept column with the name of
a result column is replaced by it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._rows import map_texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Look-alikes of Latin letters, and zero digits of other scripts.
LOOK_ALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "α": "a", "ɡ": "g", "ı": "i",
    "﹫": "@", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "　": " ",
}
ZEROS = "٠۰०০੦૦୦௦౦೦൦๐໐༠၀０"
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"

HOMOGLYPHS = {ord(k): v for k, v in LOOK_ALIKES.items()}
HOMOGLYPHS |= {ord(z) + i: str(i) for z in ZEROS for i in range(10)}
HOMOGLYPHS |= {c + 0xFEE0: chr(c) for c in range(0x21, 0x7F)}


#: Letters of an input that are looked for before the machine is set on a place.
HEAD = 4


class Transducer:
    """Deterministic longest-match rewriting over a trie.

    Each rule has an input, an output, and whether it must stand apart from letters and digits.
    """

    def __init__(self, rules: list[tuple[str, str, bool]]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: dict[int, tuple[str, bool]] = {}
        for text, out, apart in rules:
            at = 0
            for c in text:
                if c not in self.arcs[at]:
                    self.arcs[at][c] = len(self.arcs)
                    self.arcs.append({})
                at = self.arcs[at][c]
            self.final[at] = (out, apart)
        #: Where a rule may fit: beginnings of the inputs, so nothing is rewritten in a text without one.
        self.heads = re.compile(self._heads(0, HEAD))

    def _heads(self, at: int, depth: int) -> str:
        if not depth or at in self.final:
            return ""
        return "(?:" + "|".join(re.escape(c) + self._heads(to, depth - 1) for c, to in self.arcs[at].items()) + ")"

    def run(self, text: str, folded: str) -> tuple[str, list[int], list[int], list[bool]]:
        """Output, the source span of each of its characters, and whether it was rewritten."""
        arcs, final, search = self.arcs, self.final, self.heads.search
        out, start, end, changed = [], [], [], []
        i, last, n = 0, 0, len(text)

        def copy(to: int) -> None:
            out.append(text[last:to])
            start.extend(range(last, to))
            end.extend(range(last + 1, to + 1))
            changed.extend([False] * (to - last))

        while m := search(folded, i):
            i = m.start()
            at, j, best = 0, i, None
            while j < n and (at := arcs[at].get(folded[j], -1)) >= 0:
                j += 1
                if at in final:
                    made, apart = final[at]
                    if not apart or (not (i and folded[i - 1].isalnum()) and not (j < n and folded[j].isalnum())):
                        best = (j, made)
            if not best:
                i += 1
                continue
            copy(i)
            out.append(best[1])
            start.extend([i] * len(best[1]))
            end.extend([best[0]] * len(best[1]))
            changed.extend([True] * len(best[1]))
            i = last = best[0]
        copy(n)
        return "".join(out), start, end, changed


AT, DOT = "\ue000", "\ue001"  # a bare word at and a spelled dot, told apart until addresses are matched


def _rules() -> list[tuple[str, str, bool]]:
    rules = [(c, "", False) for c in ZERO_WIDTH]
    rules += [("&#64;", "@", False), ("&#46;", ".", False), ("&commat;", "@", False), ("&period;", ".", False)]
    for a, b in ("[]", "()", "{}", "<>"):
        for pad in ("", " "):
            for lead in ("", " "):
                for trail in ("", " "):
                    rules += [(f"{lead}{a}{pad}{w}{pad}{b}{trail}", o, False) for w, o in (("at", "@"), ("@", "@"), ("dot", "."), (".", "."))]
    rules += [(" at ", AT, False), (" dot ", DOT, False)]
    for i, w in enumerate(DIGIT_WORDS):
        rules.append((w, str(i), True))
    rules.append(("plus ", "+", False))
    return rules


MACHINE = Transducer(_rules())
DIGIT_GAP = re.compile(r"(?<=[0-9+])(?:[ ,]+|[ ]*-[ ]*)(?=[0-9])")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def find_emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at) if a < at else None
        if m:
            found.append((a, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def find(text: str) -> list[tuple[str, int, int]]:
    """Base identifiers as (kind, start, end)."""
    found = [("email", a, b) for a, b in find_emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


def find_disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Identifiers that show only after normalisation, with spans in the source text."""
    plain = text if text.isascii() else text.translate(HOMOGLYPHS)
    folded = plain.translate(_FOLD)
    if plain == text and not MACHINE.heads.search(folded):  # the machine would leave the text as it is
        return []
    out, start, end, changed = MACHINE.run(plain, folded)
    if plain != text:
        changed = [c or text[a:b] != plain[a:b] for c, a, b in zip(changed, start, end)]
    elif AT not in text and changed.count(True) == out.count(AT):  # words at make no identifier by themselves
        return []
    keep, last = [], 0
    for m in DIGIT_GAP.finditer(out):  # separators next to spelled digits go
        if changed[m.start() - 1] or changed[m.end()]:
            keep.extend(range(last, m.start()))
            last = m.end()
    if last:
        keep.extend(range(last, len(out)))
        out = "".join([out[i] for i in keep])
        start, end, changed = [start[i] for i in keep], [end[i] for i in keep], [changed[i] for i in keep]
    worded = out.replace(AT, "@").replace(DOT, ".")
    found = []
    for kind, a, b in find(worded):
        if not any(changed[a:b]):
            continue
        if kind == "email":
            if not re.fullmatch(r"[A-Za-z]{2,}", worded[a:b].rpartition(".")[2]):
                continue
            if AT in out[a:b] and DOT not in out[out.index(AT, a) : b]:
                continue
        elif AT in out[a:b]:
            continue
        s, e = start[a], end[b - 1]
        if not any(k == kind and s < y and x < e for k, x, y in base):
            found.append((kind, s, e))
    return found


def _order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in _order(spans))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Every span becomes the name of its kind in brackets; overlapping spans become one, named by the first."""
    out, last = [], 0
    merged: list[list] = []
    for kind, a, b in _order(spans):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(b, merged[-1][2])
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def detect(docs: DataFrame, keep: list[str], text_col: str = "text", redacted: bool = False) -> DataFrame:
    """The kept columns with n_email, n_ip, n_card and n_phone (base identifiers), n_disguised, base and
    spans (kind:start:end, comma-joined), base_sha256; with redacted, a column of the text column's name
    in which every span, disguised ones included, is replaced by its kind. A null text stays null."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("n_disguised", T.LongType())]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    if redacted:
        fields.append(docs.schema[text_col])

    def factory():
        def apply(texts: pa.Array) -> dict:
            made: dict[str, list] = {f.name: [] for f in fields}
            for t in texts.to_pylist():
                base = find(t) if t else []
                more = find_disguised(t, base) if t else []
                for k in KINDS:
                    made[f"n_{k}"].append(sum(s[0] == k for s in base))
                made["n_disguised"].append(len(more))
                made["base_sha256"].append(hashlib.sha256(digest(base).encode()).hexdigest())
                made["spans"].append(digest([*base, *more]))
                if redacted:
                    made[text_col].append(redact(t, [*base, *more]) if t else t)
            return made

        return apply

    return map_texts(docs, keep, fields, factory, text=text_col)

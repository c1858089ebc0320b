"""Personal data: exact patterns, and a linear-chain conditional random field beside them.

The patterns decide the base spans. The random field reads word shapes around digits and at-signs
and adds what the patterns leave out, such as telephone numbers without a plus sign or addresses
with the at-sign spelt out. It is trained from the small labelled table below and decoded by the
Viterbi algorithm over numpy batches of sequences.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base. Where the definition repeats a class the repetition is
# possessive or starts at a run's start, which finds the same matches without trying them twice.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: at each at-sign with a domain, back over the local part."""
    done = 0
    for match in _DOMAIN.finditer(text):
        start = at = match.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = match.end()
            yield start, done


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the pattern matches that pass their checks, ordered by start, then kind."""
    out: list[tuple[int, int, str]] = []
    if "@" in text:
        out += ((start, end, "email") for start, end in _emails(text))
    if _DIGIT.search(text):
        for match in _IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part[-9:]) <= 255 for part in match[0].split(".")):
                out.append((match.start(), match.end(), "ip"))
        for match in _CARD.finditer(text):
            digits = match[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((match.start(), match.end(), "card"))
        if "+" in text:
            for match in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", match[0])) <= 15:
                    out.append((match.start(), match.end(), "phone"))
    return sorted(out, key=lambda span: (span[0], KINDS.index(span[2])))


# The labelled table: words, those of a span in braces behind the kind's first letter.
LABELLED = (
    "call p{(020) 555-0173} after noon", "tel. p{(415) 555-0198} or write", "phone: p{212-555-0142}", "p{555-014-2277} is my number",
    "fax p{030 555 0191} office", "ring p{0171 5550 123} today", "Telefon p{089/555-0133}, bitte", "mobile p{07700 900123}.",
    "p{+44 20 7946 0018} head office", "p{+1 (303) 555-0110} and p{+1 (303) 555-0111}", "reach me at p{303.555.0144} please",
    "her number p{(646)555-0177} was lost", "numéro p{01 55 55 01 23} merci", "teléfono p{91 555 01 44} gracias",
    "write to e{ana@mail.example.com} now", "e{joe.doe@example.org}, thanks", "mail e{jo(at)example.com} or",
    "e{kim [at] example [dot] org} for help", "contact e{lee(at)example(dot)net}", "e{max AT example.com} wrote 3 times",
    "e{sue [at] mail.example.net}", "the address e{info@example.com}", "e{ben (at) example (dot) com} soon",
    "host i{10.20.30.40} is down", "from i{192.168.10.7} to i{172.16.4.9}", "ping i{8.8.4.4}:53 failed", "server i{203.0.113.77}, rack 4",
    "card c{4111 1111 1111 1111} expires 12/27", "paid with c{5500-0000-0000-0004}", "c{340000000000009} amex", "number c{4012888888881881} ok",
    "Visa c{4222.2222.2222.2222}", "c{6011 0000 0000 0004} was declined",
    "in 1998 and 2004 there were 30 of them", "the 12 apostles", "on 2024-05-17 at 10:30", "see page 345, lines 10-20",
    "version 2.10.4 was released", "it cost 1,299.50 euro", "chapter 3.2.1 of the book", "from 1914-1918 and 1939-1945",
    'token = "9f86d081884c7d659a2f" was revoked', 'key "a1b2c3d4e5f60718293a4b5c" expired', "commit 3f2a9bd fixed it",
    "order 100200300 shipped", "id 2390409500648961 unknown", "isbn 978-3-16-148410-0", "1,000,000 people", "pi is 3.14159265",
    "step 1) and 2) of 10", "room 12-34 on floor 5", "at 7 pm", "look @ this", "meet @ noon", "user @home said 5", "50 % or 0.5",
    "scores 21-19 and 15-21", "the 3rd of 4 parts", "A4 and B52", "x2 = 49", "2001: a film", "no. 17 (of 20)", "(1998) 12, 345-367",
    "write to e{max AT example.com} today", "e{jo (AT) example.com}", "e{KIM (AT) EXAMPLE (DOT) ORG}", "mail e{SUE [AT] MAIL.EXAMPLE.NET} now",
    "e{ana at example dot com}", "write to e{lee at example dot net} please", "contact: e{ben AT example DOT org}", "or e{amy at mail dot example dot org}",
    "mail e{JO [AT] EXAMPLE [DOT] COM} soon", "we met at noon and left", "look at example.com for more", "MEET AT NOON", "THEY WERE AT HOME",
    "she was good at dot painting", "at the end a dot was seen", "he sat at the table by the sea", "LOOK AT THE DOT ON THE MAP",
    "tel quel il a dit", "card games and phone calls of 1999", "mail came at 9", "one [at] a time", "row 5 (at) end",
)
_MARK = re.compile(r"([peic])\{([^}]*)\}")
_BY_LETTER = {kind[0]: kind for kind in KINDS}
_WORD = re.compile(r"\S+")
_LABELS = ("O", *(f"{part}-{kind}" for kind in KINDS for part in "BI"))
_CUES = frozenset("call tel phone telefon téléfono teléfono mobile fax ring number numéro card visa amex mail address host ping server from to at".split())
_SHAPE = ((re.compile("[0-9]+"), lambda m: "9" * min(len(m[0]), 5) + "+" * (len(m[0]) > 5)), (re.compile("[^\\W0-9_a-z]+"), "A"), (re.compile("[a-zß-ÿ]+"), "a"))
#: Words on each side of a word with a digit, an at-sign or a spelt at or dot that the field reads along.
REACH = 4
#: Words decoded as one block, words a block reads into its neighbours, and words decoded side by side.
BLOCK_WORDS, BLOCK_OVERLAP, SIDE_BY_SIDE = 2048, 64, 16_384
#: Whatever _NEEDS asks for has one of these: a superset, so no sound span is passed over.
_TRIGGER = re.compile(r"[0-9@]|(?<![^\W_])(?:at|dot)(?![^\W_])", re.IGNORECASE)


_SPELT = re.compile(r"[(\[](?:at|dot)[)\]]", re.IGNORECASE)


@functools.lru_cache(maxsize=100_000)
def _shape(word: str) -> str:
    for pattern, put in _SHAPE:
        word = pattern.sub(put, word)
    return word[:24]


def _spelt_out(words: list[str]) -> dict[int, str]:
    """Places of words in ``name at host dot end`` and ``name AT host.end``, with or without brackets."""
    out: dict[int, str] = {}
    bare = [word.strip("()[].,;:\"'").lower() for word in words]
    for k in range(1, len(words) - 1):
        if bare[k] == "at":
            stop = k + 1
            while stop + 2 < len(words) and bare[stop + 1] == "dot":
                stop += 2
            if stop > k + 1 or (words[k] != "at" and "." in bare[stop]):
                out |= {k - 1: "name", **dict.fromkeys(range(k, stop + 1), "rest")}
    return out


def _features(words: list[str]) -> list[list[str]]:
    shapes, spelt_out = [_shape(word) for word in words], _spelt_out(words)
    out = []
    for k, word in enumerate(words):
        bare = word.strip(".,;:()\"'").lower()
        digits = sum(map(word.count, "0123456789"))
        row = [
            "bias", f"s={shapes[k]}", f"digits={min(digits, 20)}", f"mixed={word.isalnum() and not word.isdigit() and digits > 0}",
            f"plus={word[0] == '+'}", f"round={word[0] == '('}", f"dots={min(word.count('.'), 4)}", f"dash={min(word.count('-'), 3)}",
            f"at={'@' in word}", f"spelt={bool(_SPELT.search(word))}", f"quote={word[0] == chr(34)}",
        ]
        row.append(f"p={shapes[k - 1]}" if k else "first")
        row.append(f"n={shapes[k + 1]}" if k + 1 < len(words) else "last")
        if k in spelt_out:
            row.append(f"spelt-out={spelt_out[k]}")
        if bare in _CUES:
            row.append(f"w={bare}")
        if k and words[k - 1].strip(".,;:").lower() in _CUES:
            row.append(f"pw={words[k - 1].strip('.,;:').lower()}")
        out.append(row)
    return out


class Field(NamedTuple):
    known: dict[str, int]
    emit: np.ndarray  #: features x labels
    step: np.ndarray  #: labels x labels
    start: np.ndarray  #: labels


def _labelled() -> Iterator[tuple[list[str], list[int]]]:
    for line in LABELLED:
        words, labels = [], []
        at = 0
        for match in (*_MARK.finditer(line), None):
            before = line[at:match.start() if match else len(line)].split()
            if before and match is None and at and line[at] != " ":
                before = before[1:]  # punctuation glued to a span belongs to its last word
            words += before
            labels += [0] * len(before)
            if match:
                inside = match[2].split()
                first = _LABELS.index(f"B-{_BY_LETTER[match[1]]}")
                words += inside
                labels += [first] + [first + 1] * (len(inside) - 1)
                at = match.end()
        yield words, labels


def _sum_exp(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


@functools.cache
def trained_field(rounds: int = 150, ridge: float = 0.05) -> Field:
    """The field, fitted by full-batch steps with per-weight rates on the regularised likelihood."""
    table = [(_features(words), labels) for words, labels in _labelled()]
    known: dict[str, int] = {}
    for rows, _ in table:
        for row in rows:
            for name in row:
                known.setdefault(name, len(known))
    data = []
    for rows, labels in table:
        matrix = np.zeros((len(rows), len(known)))
        for k, row in enumerate(rows):
            matrix[k, [known[name] for name in row]] = 1
        data.append((matrix, np.array(labels)))
    count = len(_LABELS)
    sizes = (len(known) * count, count * count, count)
    weights, seen = np.zeros(sum(sizes)), np.full(sum(sizes), 1e-8)
    parts = lambda flat: (
        flat[: sizes[0]].reshape(-1, count), flat[sizes[0]:sizes[0] + sizes[1]].reshape(count, count), flat[-count:]
    )
    for _ in range(rounds):
        emit, step, start = parts(weights)
        slope = -ridge * weights
        d_emit, d_step, d_start = parts(slope)
        for matrix, labels in data:
            scores, size = matrix @ emit, len(labels)
            ahead, back = np.zeros((size, count)), np.zeros((size, count))
            ahead[0] = start + scores[0]
            for k in range(1, size):
                ahead[k] = _sum_exp(ahead[k - 1][:, None] + step, 0) + scores[k]
            for k in range(size - 2, -1, -1):
                back[k] = _sum_exp(step + (scores[k + 1] + back[k + 1])[None, :], 1)
            total = _sum_exp(ahead[-1], 0)
            chance = np.exp(ahead + back - total)
            gold = np.eye(count)[labels]
            d_emit += matrix.T @ (gold - chance)
            d_start += gold[0] - chance[0]
            for k in range(1, size):
                pair = np.exp(ahead[k - 1][:, None] + step + (scores[k] + back[k])[None, :] - total)
                d_step -= pair
                d_step[labels[k - 1], labels[k]] += 1
        seen += slope**2
        weights += 0.5 * slope / np.sqrt(seen)
    emit, step, start = parts(weights)
    for k, name in enumerate(_LABELS):  # an inner label only follows its own kind
        if name[0] == "I":
            start[k] = -np.inf
            for j, before in enumerate(_LABELS):
                if before[2:] != name[2:]:
                    step[j, k] = -np.inf
    return Field(known, emit, step, start)


def viterbi(field: Field, sequences: list[list[str]]) -> list[np.ndarray]:
    """Best label numbers of each word sequence.

    A sequence of more than ``BLOCK_WORDS`` is decoded in blocks that reach ``BLOCK_OVERLAP`` words into
    their neighbours, so memory does not grow with a line; blocks of like length go side by side.
    """
    blocks = [
        (number, start, max(0, start - BLOCK_OVERLAP), words[max(0, start - BLOCK_OVERLAP):start + BLOCK_WORDS + BLOCK_OVERLAP])
        for number, words in enumerate(sequences) for start in range(0, len(words), BLOCK_WORDS)
    ]
    out = [np.empty(len(words), int) for words in sequences]
    blocks.sort(key=lambda block: len(block[3]))
    first = 0
    while first < len(blocks):
        last = first + 1
        while last < len(blocks) and (last + 1 - first) * len(blocks[last][3]) <= SIDE_BY_SIDE:
            last += 1
        for (number, start, begin, words), labels in zip(blocks[first:last], _decode(field, [block[3] for block in blocks[first:last]]), strict=True):
            own = labels[start - begin:start - begin + BLOCK_WORDS]
            out[number][start:start + len(own)] = own
        first = last
    return out


def _decode(field: Field, sequences: list[list[str]]) -> list[np.ndarray]:
    """Best label numbers of non-empty sequences, the longest last, all at once."""
    longest = len(sequences[-1])
    scores = np.zeros((len(sequences), longest, len(_LABELS)))
    for row, words in enumerate(sequences):
        for place, names in enumerate(_features(words)):
            found = [field.known[name] for name in names if name in field.known]
            scores[row, place] = field.emit[found].sum(axis=0)
    best, origin = field.start + scores[:, 0], np.zeros(scores.shape, np.int8)
    ends = np.array([len(words) - 1 for words in sequences])
    final = np.where((ends == 0)[:, None], best, -np.inf)
    for place in range(1, longest):
        options = best[:, :, None] + field.step[None]
        origin[:, place] = options.argmax(axis=1)
        best = options.max(axis=1) + scores[:, place]
        final = np.where((ends == place)[:, None], best, final)
    out = []
    for row, end in enumerate(ends):
        path = np.empty(end + 1, int)
        path[-1] = final[row].argmax()
        for place in range(end, 0, -1):
            path[place - 1] = origin[row, place, path[place]]
        out.append(path)
    return out


def _stretches(text: str) -> list[list[tuple[int, int]]]:
    """Words near a trigger, as runs of (start, end); a span without any would not be sound. None crosses a line."""
    out: list[list[tuple[int, int]]] = []
    for line in _LINE.finditer(text):
        if not _TRIGGER.search(text, line.start(), line.end()):
            continue
        words = [(m.start(), m.end()) for m in _WORD.finditer(text, line.start(), line.end())]
        upto = -1  # the last word taken
        for k, (start, end) in enumerate(words):
            if _TRIGGER.search(text, start, end):
                if k - REACH > upto + 1 or upto < 0:
                    out.append([])
                    upto = max(upto, k - REACH - 1)
                after = min(len(words), k + REACH + 1)
                out[-1] += words[upto + 1:after]
                upto = after - 1
    return out


_LINE = re.compile(r"[^\n]+")
_EDGE = "\"'.,;:!?|#$%&*<>"
#: What a span of the field must hold, whatever its words look like.
_NEEDS = {
    "email": re.compile(
        r"[A-Za-z0-9]\s*(?:@|[(\[]\s*(?i:at)\s*[)\]]|\sAT\s+[A-Za-z0-9.-]*[A-Za-z0-9]\.(?=[A-Za-z])"
        r"|\s(?i:at)\s.*[A-Za-z0-9]\s*[(\[\s]\s*(?i:dot)\s*[)\]\s]).*[A-Za-z]", re.DOTALL
    ),
    "ip": re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), "card": re.compile(r"(?:[0-9][^0-9]?){12,19}"),
    "phone": re.compile(r"(?:[0-9][^0-9]{0,3}){7,15}"),
}


def _is_sound(kind: str, text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    if kind == "card":
        return 12 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search(r"[A-Za-z\"]", text)
    if kind == "ip":
        return all(len(part) <= 3 and int(part or 0) <= 255 for part in re.findall("[0-9]+", text)[:4]) and bool(_NEEDS[kind].search(text))
    return bool(_NEEDS[kind].search(text))


def field_spans(field: Field, texts: list[str], base: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """Spans the field adds to each text: sound ones that touch no base span."""
    owners, stretches = [], []
    for k, text in enumerate(texts):
        for stretch in _stretches(text):
            owners.append(k)
            stretches.append(stretch)
    paths = viterbi(field, [[texts[k][a:b] for a, b in stretch] for k, stretch in zip(owners, stretches)])
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k, stretch, path in zip(owners, stretches, paths):
        text, at = texts[k], 0
        while at < len(path):
            name = _LABELS[path[at]]
            stop = at + 1
            if name[0] == "B":
                while stop < len(path) and _LABELS[path[stop]] == "I" + name[1:]:
                    stop += 1
                start, end = stretch[at][0], stretch[stop - 1][1]
                while start < end and text[start] in _EDGE:
                    start += 1
                while end > start and text[end - 1] in _EDGE:
                    end -= 1
                if _is_sound(name[2:], text[start:end]) and not any(a < end and start < b for a, b, _ in base[k]):
                    out[k].append((start, end, name[2:]))
            at = stop
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


_FOUND = pa.struct([*((f"n_{kind}", pa.int64()) for kind in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
_FOUND_TYPE = T.StructType([
    *(T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS), T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
])
#: Characters of the texts that are decoded together.
_TOGETHER = 2_000_000


def find_personal_data(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone and base_sha256 of the patterns, and spans of both.

    The counts and the digest are those of the base, ``spans`` lists base spans and what the field
    adds, by start, then kind. Null and empty texts have none. Rows are read one by one; columns
    named like a result are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained_field())

    def rows(texts: list[str]) -> Iterator[dict]:
        base = [base_spans(value) for value in texts]
        for own, added in zip(base, field_spans(shared.value, texts, base)):
            kinds = [kind for _, _, kind in own]
            every = sorted([*own, *added], key=lambda span: (span[0], KINDS.index(span[2])))
            yield {
                **{f"n_{kind}": kinds.count(kind) for kind in KINDS},
                "base_sha256": hashlib.sha256(_joined(own).encode()).hexdigest(), "spans": _joined(every),
            }

    @F.arrow_udf(_FOUND_TYPE)
    def found(texts: pa.Array) -> pa.Array:
        out, group, size = [], [], 0
        for value in texts:
            group.append(value.as_py() or "")
            size += len(group[-1])
            if size >= _TOGETHER:
                out += rows(group)
                group, size = [], 0
        return pa.array([*out, *rows(group)], _FOUND)

    marked = docs.withColumn("_found", found(text))
    return marked.withColumns({name: F.col(f"_found.{name}") for name in _FOUND_TYPE.names}).drop("_found")

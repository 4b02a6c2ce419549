"""Personal data: fixed patterns and a linear-chain conditional random field (operator 9).

The patterns find e-mail addresses, IP addresses, card numbers and international phone numbers. The field adds what
they cannot express: national phone numbers, secrets and identity numbers, told by word shapes in context. It is
trained on a small labelled table made by rule in ``labelled_table`` and decoded by Viterbi over padded numpy batches.

Every labelled kind but the secret holds a digit, so the field reads the tokens around each token with a digit and around
each word that names a secret; runs that overlap are one sequence. Everything else in a text is outside any span by the definition of the labels.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released

BASE = ("email", "ip", "card", "phone")
ADDED = ("phone", "secret", "id")
KINDS = ("email", "ip", "card", "phone", "secret", "id")
RANK = {k: i for i, k in enumerate(KINDS)}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]+")
SPACE = re.compile(r"\s")
#: A digit, or a word that names a secret.
CLUE = re.compile(r"[0-9]+|(?<![A-Za-z])(?:[Tt]oken|TOKEN|[Pp]assw(?:or)?d|PASSW(?:OR)?D|[Pp]wd|PWD|[Ss]ecret|SECRET|[Aa]pikey|APIKEY|[Kk]ey|KEY)(?![A-Za-z])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start, then kind.

    An e-mail's local part is the longest run of its characters before an @, since the leftmost match starts there;
    looking from each @ gives the same matches as a scan and stays linear on long runs.
    """
    out: list[tuple[int, int, str]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = max(done, start)
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
                    out.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], RANK[s[2]]))
    return out


# ---- the conditional random field

LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
INDEX = {k: i for i, k in enumerate(LABELS)}
SLOTS = 1 << 13
TOKEN = re.compile(r"[^\s\"'<>=,;()\[\]{}]+|[\"'=()]")
#: Words whose presence beside a token is a feature of their own; all others are known by shape only.
CUES = frozenset("token password passwd secret key apikey pwd phone tel telephone call fax mobile cell ssn iban passport id nr number card visa ip host email mail version page chapter year in of the costs".split())
#: Tokens read on each side of a clue.
CONTEXT = 4


def shape(word: str) -> tuple[str, ...]:
    """Features of a token alone; those of words of usual length are remembered."""
    return _remembered_shape(word) if len(word) <= 64 else _shape(word)


def _shape(word: str) -> tuple[str, ...]:
    full = "".join("d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)
    short = re.sub(r"(.)\1+", r"\1+", full)
    digits = sum(c.isdigit() for c in word)
    hexa = len(word) >= 12 and digits >= 3 and all(c in "0123456789abcdefABCDEF" for c in word)
    low = word.lower()
    return (f"s={short}", f"f={full}" if digits and len(full) < 16 else "f=", f"n={min(len(word), 40) // 4}", f"d={min(digits, 20)}", f"h={hexa}", f"m={digits > 0 and any(c.isalpha() for c in word)}", f"w={low}" if low in CUES else "w=")


_remembered_shape = lru_cache(1 << 14)(_shape)


def slot(feature: str) -> int:
    return _remembered_slot(feature) if len(feature) <= 128 else _slot(feature)


def _slot(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % SLOTS


_remembered_slot = lru_cache(1 << 16)(_slot)


def forget() -> None:
    """Empty what is remembered of shapes and slots: a worker serves other stages after this one."""
    _remembered_shape.cache_clear()
    _remembered_slot.cache_clear()


def features(words: list[str]) -> list[list[int]]:
    """Feature slots of every token: its own, its neighbours' shapes and cues, and shape pairs."""
    own = [shape(w) for w in words]
    pad = ("s=^", "f=", "n=0", "d=0", "h=False", "m=False", "w=")
    out = []
    for i, o in enumerate(own):
        b, a = own[i - 1] if i else pad, own[i + 1] if i + 1 < len(own) else pad
        bb = own[i - 2] if i > 1 else pad
        out.append([slot(x) for x in (*o, "-" + b[0], "-" + b[6], "+" + a[0], "=" + bb[6], "=" + bb[0], f"{b[0]}|{o[0]}", f"{o[0]}|{a[0]}", "#" + (own[i - 3] if i > 2 else pad)[6])])
    return out


WIDTH = 15


def labelled_table(rows: int = 700, seed: int = 5) -> list[list[tuple[str, str]]]:
    """The training table: sequences of (token, label), made by rule from a fixed seed. No row of any corpus is in it."""
    r = np.random.RandomState(seed)
    syllables = "the of and to in er st ha on ti re le de que der ein sch la os ment eau an".split()

    def digits(n: int) -> str:
        return "".join(str(r.randint(10)) for _ in range(n))

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        w = w.capitalize() if r.rand() < 0.15 else w
        return w + "." if r.rand() < 0.1 else w

    def hexa(n: int) -> str:
        return "".join("0123456789abcdef"[r.randint(16)] for _ in range(n))

    def mixed(n: int) -> str:
        return "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"[r.randint(62)] for _ in range(n - 2)) + "7q"

    def letters(n: int) -> str:
        plain = "".join("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[r.randint(26 if n % 2 else 52)] for _ in range(n))
        return plain if r.rand() < 0.5 else "".join(r.choice(syllables) for _ in range(n // 2))

    def entity() -> tuple[str, str]:
        kind = ["email", "ip", "card", "phone", "national", "secret", "id", "none"][r.choice(8, p=[0.08, 0.08, 0.08, 0.1, 0.2, 0.14, 0.1, 0.22])]
        lead = ""
        if kind == "email":
            return kind, f"{r.choice(syllables)}{digits(2)}@{r.choice(syllables)}{digits(1)}.example.{r.choice(['com', 'org', 'net'])}"
        if kind == "ip":
            return kind, ".".join(str(r.randint(256)) for _ in range(4))
        if kind == "card":
            return kind, digits(16) if r.rand() < 0.6 else " ".join(digits(4) for _ in range(4))
        if kind == "phone":
            return kind, f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}" if r.rand() < 0.6 else f"+{digits(2)} {digits(3)} {digits(6)}"
        if kind == "national":
            f = r.randint(4)
            lead = r.choice(["call ", "phone ", "tel ", "", ""])
            return "phone", lead + "\0" + [f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"({digits(3)}) {digits(3)} {digits(4)}"][f]
        if kind == "secret":
            name = r.choice(["token", "password", "secret", "key", "passwd"])
            value = hexa(r.randint(16, 48)) if r.rand() < 0.7 else mixed(r.randint(16, 40))
            if r.rand() < 0.3:
                value = letters(r.randint(10, 32))
            return kind, [f'{name} = "\0{value}"', f"{name}=\0{value}", f"{name} = \0{value}"][r.randint(3)]
        if kind == "id":
            return kind, r.choice(["ssn ", "", "id "]) + "\0" + f"{digits(3)}-{digits(2)}-{digits(4)}" if r.rand() < 0.6 else "iban \0" + f"DE{digits(20)}"
        if r.rand() < 0.35:  # no secrets: names of secrets in prose, and other values set
            name, other = r.choice(["token", "password", "secret", "key", "passwd"]), r.choice(["lang", "name", "title", "class", "word", "type"])
            return "none", [f"{name} {word()} {word()}", f"the {name} is {word()}", f'{other} = "{letters(r.randint(4, 24))}"', f"{other}={letters(r.randint(4, 24))}", f"{other} = {letters(r.randint(4, 24))}"][r.randint(5)]
        return "none", [digits(r.randint(1, 5)), f"{r.randint(10)}.{r.randint(10)}", f"19{digits(2)}", f"20{digits(2)}-0{r.randint(1, 10)}-1{r.randint(10)}", f"{digits(2)}%", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(3)} {digits(3)}", f"version {r.randint(9)}.{r.randint(9)}", hexa(12), f"({r.randint(99)})", f"x{digits(2)}", f"{digits(4)}-{digits(4)}", f"3{digits(8)}"][r.randint(14)]

    table = []
    for _ in range(rows):
        row: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 4)):
            row += [(w, "O") for w in TOKEN.findall(" ".join(word() for _ in range(r.randint(1, 7))))]
            kind, text = entity()
            lead, _, value = text.rpartition("\0")
            row += [(w, "O") for w in TOKEN.findall(lead)]
            first = True
            for w in TOKEN.findall(value):
                if kind == "none" or kind == "secret" and w == '"':
                    row.append((w, "O"))
                else:
                    row.append((w, ("B-" if first else "I-") + kind))
                    first = False
            row += [(w, "O") for w in TOKEN.findall(" ".join(word() for _ in range(r.randint(1, 5))))]
        table.append(row)
    return table


def _padded(sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(s) for s in sequences])
    x = np.full((len(sequences), length.max(), WIDTH), SLOTS, np.int64)
    for i, s in enumerate(sequences):
        x[i, : len(s)] = s
    return x, length


def train(table: list[list[tuple[str, str]]] | None = None, rounds: int = 30, rate: float = 0.3, penalty: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights (slots + 1, labels) and transitions (labels + 1, labels; the last row is the start), by maximum
    likelihood: forward-backward over padded batches, with AdaGrad steps."""
    table = table or labelled_table()
    r, k = np.random.RandomState(3), len(LABELS)
    w, t = np.zeros((SLOTS + 1, k)), np.zeros((k + 1, k))
    gw, gt = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    data = [(features([x for x, _ in row]), [INDEX[y] for _, y in row]) for row in table]
    for _ in range(rounds):
        order = r.permutation(len(data))
        for at in range(0, len(order), 100):
            part = [data[i] for i in order[at : at + 100]]
            x, length = _padded([f for f, _ in part])
            n, m = x.shape[:2]
            live = np.arange(m) < length[:, None]
            score = w[x].sum(2)
            local, move = np.exp(score - score.max(2, keepdims=True)), np.exp(t)
            # forward and backward values are scaled at every step, so that they stay in range on long sequences
            forward, backward = np.zeros((n, m, k)), np.ones((n, m, k))
            for i in range(m):
                got = local[:, i] * (forward[:, i - 1] @ move[:k] if i else move[k])
                got /= got.sum(1, keepdims=True)
                forward[:, i] = np.where(live[:, i, None], got, forward[:, i - 1])
            for i in range(m - 2, -1, -1):
                got = (local[:, i + 1] * backward[:, i + 1]) @ move[:k].T
                backward[:, i] = np.where(live[:, i + 1, None], got / got.sum(1, keepdims=True), 1)
            single = forward * backward
            single *= live[:, :, None] / single.sum(2, keepdims=True)
            dt = np.zeros_like(t)
            dt[k] -= single[:, 0].sum(0)
            for i in range(1, m):
                left, right = forward[:, i - 1], local[:, i] * backward[:, i]
                share = live[:, i] / np.einsum("na,ab,nb->n", left, move[:k], right, optimize=True)
                dt[:k] -= move[:k] * (left.T @ (right * share[:, None]))
            error = -single
            for i, (_, y) in enumerate(part):
                error[i, np.arange(len(y)), y] += 1
                np.add.at(dt, ([k, *y[:-1]], y), 1)
            flat = x.ravel()
            dw = np.stack([np.bincount(flat, np.repeat(error[:, :, j].ravel(), WIDTH), SLOTS + 1) for j in range(k)], axis=1)
            dw[SLOTS] = 0
            dw -= penalty * w
            gw += dw**2
            gt += dt**2
            w += rate * dw / np.sqrt(gw)
            t += rate * dt / np.sqrt(gt)
    return w, t


@lru_cache(1)
def default_model() -> tuple[np.ndarray, np.ndarray]:
    """The field trained on the table made by rule; the same on every machine, so once a process is enough."""
    return train()


def decode(model: tuple[np.ndarray, np.ndarray], sequences: list[list[str]]) -> list[np.ndarray]:
    """Best label numbers of each token sequence: Viterbi over batches of sequences of near equal length."""
    w, t = model
    k, out = len(LABELS), [np.zeros(0, int)] * len(sequences)
    order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
    at = 0
    while at < len(order):
        size = max(1, min(256, 20_000 // len(sequences[order[min(at + 255, len(order) - 1)]])))
        part = order[at : at + size]
        at += size
        x, length = _padded([features(sequences[i]) for i in part])
        n, m = x.shape[:2]
        best = w[x[:, 0]].sum(1) + t[k]
        back = np.zeros((n, m, k), np.int8)
        for i in range(1, m):
            step = best[:, :, None] + t[None, :k]
            back[:, i] = step.argmax(1)
            got = step.max(1) + w[x[:, i]].sum(1)
            best = np.where((i < length)[:, None], got, best)
        label = best.argmax(1)
        path = np.zeros((n, m), int)
        for i in range(m - 1, -1, -1):
            inside = i < length
            path[inside, i] = label[inside]
            label = np.where(inside & (i > 0), back[np.arange(n), i, label], label)
        for row, i in enumerate(part):
            out[i] = path[row, : length[row]]
    return out


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Token offsets around every clue; overlapping runs are joined."""
    out: list[list[tuple[int, int]]] = []
    reach = 12 * CONTEXT
    at = 0
    m = CLUE.search(text)
    while m:
        start, end = max(at, m.start() - reach), m.end()
        while True:  # to the last clue within reach of the one before
            n = CLUE.search(text, end, min(len(text), end + reach))
            if not n:
                break
            end = n.end()
        stop = min(len(text), end + reach)
        # whole tokens, however long: windows never overlap, so this stays linear
        while start > at and not text[start - 1].isspace():
            start -= 1
        blank = SPACE.search(text, stop)
        stop = blank.start() if blank else len(text)
        out.append([x.span() for x in TOKEN.finditer(text, start, stop)])
        at = stop
        m = CLUE.search(text, stop)
    return out


TRAILING = ".:!?-"


def field_spans(model: tuple[np.ndarray, np.ndarray], texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """The field's spans of each text, of the added kinds; each but the secrets holds a digit."""
    runs = [(i, run) for i, text in enumerate(texts) for run in windows(text) if run]
    labels = decode(model, [[texts[i][a:b] for a, b in run] for i, run in runs])
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (i, run), got in zip(runs, labels):
        text, p = texts[i], 0
        while p < len(run):
            name = LABELS[got[p]]
            q = p + 1
            if name != "O":
                kind = name[2:]
                while q < len(run) and LABELS[got[q]] == f"I-{kind}":
                    q += 1
                start, end = run[p][0], run[q - 1][1]
                while end > start and text[end - 1] in TRAILING:
                    end -= 1
                if kind in ADDED and start < end and (kind == "secret" or DIGIT.search(text, start, end)):
                    out[i].append((start, end, kind))
            p = q
    return out


def all_spans(model: tuple[np.ndarray, np.ndarray], texts: list[str]) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base, all) spans of each text; a span of the field that meets a base span is left out."""
    out = []
    for text, extra in zip(texts, field_spans(model, texts)):
        base = base_spans(text)
        kept = [s for s in extra if not any(s[0] < b[1] and b[0] < s[1] for b in base)] if extra else []
        out.append((base, sorted(base + kept, key=lambda s: (s[0], RANK[s[2]])) if kept else base))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_personal_data(documents: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans, n_spans
    (all spans), redacted.

    Offsets are code points, ends exclusive. A null text counts as empty: no spans, redacted ''. Whole texts of any
    length are read; repeated rows are each answered, null ids stay; an empty table gives no rows. Other columns are
    not read. There is no shuffle.
    """
    weights = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                rows = []
                for text, (base, spans) in zip(texts, all_spans(weights, texts)):
                    kinds = [k for _, _, k in base]
                    rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), redact(text, spans) if spans else text))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.string()]))], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans", "redacted"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, redacted string")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("redacted")


def redact_documents(documents: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The documents, all columns, with each span of ``text`` replaced by its kind; n_chars, if there, follows. Null texts
    stay null."""
    weights = model or default_model()
    place, names = documents.columns.index("text"), documents.columns
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(place).to_pylist()
                columns = list(part.columns)
                out = [t if t is None or not spans else redact(t, spans) for t, (_, spans) in zip(texts, all_spans(weights, [t or "" for t in texts]))]
                columns[place] = pa.array(out, part.schema.field(place).type)
                if chars is not None:
                    kept = part.column(chars).to_pylist()
                    columns[chars] = pa.array([k if a is b or a == b else len(a) for k, a, b in zip(kept, out, texts)], part.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)
        forget()

    return documents.mapInArrow(released(run), documents.schema)

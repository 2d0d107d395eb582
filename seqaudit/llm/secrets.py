"""Secret scans: base patterns and a character convolutional network over every candidate."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import uniform

#: Fixed patterns of the contract. Greedy runs are matched first and short ones dropped afterwards.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}|(?<![A-Za-z0-9+/_.=-])(?=[+/_.=-]*[A-Za-z0-9+/_.=-]*[A-Za-z])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{8,15}(?![A-Za-z0-9+/_.=-])")
KINDS = ("assign", "access", "hex", "net")
_ANY = re.compile(rb"passw|secret|token|api_?key", re.IGNORECASE)

#: Characters seen by the network: LEFT before a place in the candidate, then as far as WIDTH reaches.
#: Places follow each other by STEP until LEFT characters after the candidate are seen too.
LEFT, WIDTH, TAPS, FILTERS, DIM, STEP = 24, 88, 5, 20, 8, 24


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings; start and end count code points."""
    out = []
    if _ANY.search(text.encode()):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Every run of 16 or more characters that keys and encoded values are made of, or of 8 or more with a letter and a digit.

    Shorter runs, and those of letters only under 16, are words as far as their shape tells; the base patterns see them by keyword.
    """
    return [m.span() for m in RUN.finditer(text)]


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALNUM = _DIGITS + _LOWER + _UPPER
#: How published formats of credentials begin, the symbols that follow, and how many.
FORMATS = [
    ("ghp_", _ALNUM, 36), ("gho_", _ALNUM, 36), ("github_pat_", _ALNUM + "_", 60), ("glpat-", _ALNUM + "-_", 20), ("xoxb-", _ALNUM + "-", 48),
    ("sk_live_", _ALNUM, 24), ("rk_live_", _ALNUM, 24), ("AIza", _ALNUM + "-_", 35), ("ya29.", _ALNUM + "-_", 60), ("SG.", _ALNUM + "-_.", 66),
    ("eyJ", _ALNUM + "-_.", 90), ("npm_", _ALNUM, 36), ("pypi-", _ALNUM + "-_", 80), ("dop_v1_", "0123456789abcdef", 64), ("hf_", _ALNUM, 34),
    ("ASIA", _UPPER + _DIGITS, 16), ("", _ALNUM + "+/", 40), ("", _ALNUM, 32), ("", "0123456789ABCDEF", 40), ("", _ALNUM, 20), ("", _ALNUM, 12),
]
#: Where findings of the labelled table stand, and what else stands there. A random run without a format of its own is a secret only in the first.
SECRET_PLACES = ["Authorization: Bearer {}", "export AUTH={}", "https://admin:{}@db.example.com/main", '"auth": "{}",', "credentials {} until May", "key {}", "login bob / {}", "use {} to sign in", "<value>{}</value>", "set KEY '{}'", "private key: {}", "signing key {}", "PWD={}", "X-Auth: {}", "client_key={}&"]
PLAIN_PLACES = ["see {} for more", "the file {} was moved", "{}", "in {} and elsewhere", "<a>{}</a>", "version {} of", "from {}, then", '"name": "{}",', "({})", "call {}() first", "http://{}", "item {} is sold", "by {}:", "> {}"]


def word(rng: random.Random, most: int = 4) -> str:
    """A word that can be spoken, of up to `most` syllables."""
    heads, ends = ["", *"bcdfghjklmnprstvwz", "ch", "st", "tr", "pl", "sh", "br"], ["", "", "", *"nrstlmdk", "ng", "nt", "st", "ck"]
    return "".join(rng.choice(heads) + rng.choice("aeiouaeiouy") + rng.choice(ends) for _ in range(rng.randrange(1, most + 1)))


def run_of(rng: random.Random, symbols: str, low: int, high: int | None = None) -> str:
    return "".join(rng.choice(symbols) for _ in range(rng.randint(low, high or low)))


#: Kinds of ordinary runs: each is made from a random source alone.
PLAIN = [
    lambda r: "/".join(word(r) for _ in range(r.randrange(2, 6))) + r.choice([".html", ".py", ".jpg", ""]),
    lambda r: f"www.{word(r)}{word(r)}.example.com/{word(r)}/{run_of(r, _DIGITS, 4)}",
    lambda r: f"{r.randrange(1, 9)}.{r.randrange(30)}.{r.randrange(30)}-{r.choice(['rc', 'beta', 'alpha'])}.{r.randrange(9)}",
    lambda r: f"20{run_of(r, _DIGITS, 2)}-0{r.randrange(1, 10)}-1{r.randrange(10)}T1{r.randrange(10)}.{run_of(r, _DIGITS, 2)}.{run_of(r, _DIGITS, 2)}",
    lambda r: f"{r.choice(['IMG', 'VID', 'SCAN', 'PXL', 'P'])}_20{run_of(r, _DIGITS, 6)}_{run_of(r, _DIGITS, 6)}.{r.choice(['jpg', 'png', 'mp4'])}",
    lambda r: "-".join(word(r) for _ in range(r.randrange(2, 7))) + r.choice(["", "-" + run_of(r, _DIGITS, 1, 4)]),
    lambda r: "_".join(word(r) for _ in range(r.randrange(2, 6))) + r.choice(["", run_of(r, _DIGITS, 1, 2)]),
    lambda r: f"978-{run_of(r, _DIGITS, 1)}-{run_of(r, _DIGITS, 2)}-{run_of(r, _DIGITS, 6)}-{run_of(r, _DIGITS, 1)}",
    lambda r: run_of(r, _DIGITS, 16, 22),
    lambda r: f"10.{run_of(r, _DIGITS, 4)}/{word(r)}.{run_of(r, _DIGITS, 4)}",
    lambda r: "".join(word(r) for _ in range(r.randrange(3, 9))).capitalize(),
    lambda r: f"{word(r)}.{run_of(r, _DIGITS, 2)}.mail{run_of(r, _DIGITS, 1)}.example.com",
    lambda r: f"{word(r)}{word(r)}{run_of(r, _DIGITS, 1, 4)}",
    lambda r: f"{word(r).upper()}-{run_of(r, _DIGITS, 1, 5)}",
    lambda r: run_of(r, r.choice("=-_."), 1) * r.randrange(16, 60),
    lambda r: word(r) + "".join(word(r).capitalize() for _ in range(r.randrange(1, 5))) + run_of(r, _DIGITS, 1, 2),
    lambda r: "".join(word(r).capitalize() for _ in range(r.randrange(2, 6))) + r.choice(["", run_of(r, _DIGITS, 1, 2), "." + word(r, 1)]),
    lambda r: "-".join([word(r, 2).upper()[:4], run_of(r, _DIGITS, 3, 6), r.choice(["S", "M", "XL", "A4"]), word(r, 2).upper()]),
    lambda r: run_of(r, _UPPER, 2) + run_of(r, _DIGITS, 14, 20),
    lambda r: f"{word(r).upper()}-{run_of(r, _DIGITS, 2)}{word(r)}{run_of(r, _DIGITS, 2, 4)}",
    lambda r: f"{word(r).capitalize()}.org/{word(r, 2)}/" + "_".join(word(r).capitalize() for _ in range(r.randrange(2, 7))) + r.choice(["", "_" + run_of(r, _DIGITS, 4)]),
    lambda r: run_of(r, "0123456789abcdef", 7, 16),
    lambda r: f"{r.choice('vtp')}={run_of(r, _ALNUM + '-_', 11)}",
    lambda r: "-".join(run_of(r, "0123456789abcdef", n) for n in (8, 4, 4, 4, 12)),
    lambda r: "".join(r.choice(_UPPER) + r.choice(_DIGITS) for _ in range(r.randrange(4, 7))),
    lambda r: f"{word(r, 2)}{run_of(r, _DIGITS, 1, 2)}{word(r, 1)}" + "".join("_" + word(r, 2) for _ in range(r.randrange(1, 4))),
    lambda r: word(r).upper() + "_" + word(r).upper() + run_of(r, _DIGITS, 1, 4) + r.choice(["", "." + word(r, 1)]),
    lambda r: "+".join(word(r) for _ in range(r.randrange(2, 5))) + "=" + run_of(r, _DIGITS, 1, 4),
    lambda r: f"{run_of(r, _DIGITS, 1, 3)}{word(r)}{word(r, 2)}.{word(r, 2)}",
    lambda r: "1Z" + run_of(r, _UPPER + _DIGITS, 4) + run_of(r, _DIGITS, 10),
]
PARTS = 5


def parts_but(*left: int) -> tuple[int, ...]:
    return tuple(i for i in range(PARTS) if i not in left)


def labelled(n: int, seed: int, parts: tuple[int, ...] = tuple(range(PARTS))) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): a table of labelled findings, made by rule: n credentials in published formats and n ordinary runs.

    Formats and ordinary kinds are dealt over PARTS parts; only those of the given parts occur, so that kinds can be held out.
    """
    rng = random.Random(seed)
    formats, plain = ([x for i, x in enumerate(kinds) if i % PARTS in parts] for kinds in (FORMATS, PLAIN))
    out = []
    for label in (1, 0):
        for _ in range(n):
            head, symbols, size = rng.choice(formats)
            value = head + run_of(rng, symbols, size) if label else rng.choice(plain)(rng)
            told = label and (len(value) <= 20 or rng.random() < 0.5)
            before, after = rng.choice(SECRET_PLACES if told else PLAIN_PLACES).split("{}")
            text = " ".join(word(rng) for _ in range(rng.randrange(6))) + " " + before
            out.append((text + value + after + " " + " ".join(word(rng) for _ in range(rng.randrange(8))), len(text), len(text) + len(value), label))
    return out


def labelled_windows(rows: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of every candidate of a labelled table, and whether what they show of it lies in a finding."""
    x, y = [], []
    for text, start, end, label in rows:
        spans = candidates(text)
        x.append(windows(text, spans))
        y += [int(label and max(a, s - LEFT) < end and start < min(b, s - LEFT + WIDTH)) for a, b in spans for s in places(a, b)]
    return np.concatenate(x), np.array(y)


def _classes() -> np.ndarray:
    """Symbol by code point below 256; others share one. 1-36 letters and digits by case, then marks."""
    table = np.full(257, 63, np.uint8)
    for n, c in enumerate("0123456789"):
        table[ord(c)] = 1 + n
    for n in range(26):
        table[97 + n], table[65 + n] = 11 + n, 37 + n
    table[32] = 0
    for c in "\t\n\r":
        table[ord(c)] = 0
    for n, c in enumerate("\"'=:+/_.-@"):
        table[ord(c)] = 64 + n
    return table


_CLASS = _classes()
SYMBOLS = 75


def places(a: int, b: int) -> range:
    """Where the windows of a candidate are laid; up to 40 characters have one, at the start."""
    return range(a, max(a + 1, b + LEFT - (WIDTH - LEFT) + STEP), STEP)


def windows(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """Symbols of each window of each candidate, in order; SYMBOLS is added inside the candidate."""
    laid = [(a, b, s - LEFT) for a, b in spans for s in places(a, b)]
    out = np.zeros((len(laid), WIDTH), np.uint8)
    for n, (a, b, start) in enumerate(laid):
        low = max(0, start)
        piece = np.frombuffer(text[low : start + WIDTH].encode("utf-32-le", "surrogatepass"), np.uint32)
        out[n, low - start : low - start + len(piece)] = _CLASS[np.minimum(piece, 256)]
        out[n, max(0, a - start) : max(0, min(WIDTH, b - start))] += SYMBOLS
    return out


def _forward(net: dict, x: np.ndarray):
    e = net["embed"][x]
    n = WIDTH - TAPS + 1
    patches = np.concatenate([e[:, i : i + n] for i in range(TAPS)], axis=2)
    h = np.maximum(patches @ net["conv"] + net["conv_bias"], 0)
    best = h.argmax(axis=1)
    top = np.take_along_axis(h, best[:, None, :], 1)[:, 0]
    mean = h[:, LEFT:].mean(axis=1)
    pooled = np.concatenate([top, mean], 1)
    return patches, h, best, pooled, pooled @ net["out"] + net["out_bias"]


def logits(net: dict, x: np.ndarray) -> np.ndarray:
    return np.concatenate([_forward(net, x[i : i + 256])[4] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0)


def probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net["scale"] * logits(net, x) + net["shift"], -30, 30)))


def train(docs: DataFrame, sample_docs: int = 12_000, findings: int = 4000, recall: float = 0.95, epochs: int = 8, seed: int = 7, most: int = 2000, negatives: int = 6, calibration: int = 0, left_out: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Fit the network to a table of labelled findings and to those of about sample_docs documents (taken by a hash of the id).

    The table (see labelled) has `findings` credentials of kinds that the base patterns miss, and as many ordinary runs. A window of a
    document is labelled 1 if what it shows of its candidate overlaps a base finding; at most `most` such windows and `negatives`
    times as many others are used. Half of them are repeated with the surroundings of a negative, so that shape counts and
    not the keyword alone. Part `calibration` of the table's formats and ordinary kinds, and a fifth of the documents' windows, are not
    fitted: they scale the outputs (Platt), so that these are probabilities for kinds never seen, and set the threshold, the highest that
    keeps the wanted recall of the table's findings there. Parts in left_out are used for neither (a test measures on them).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")
    rate = min(1.0, sample_docs / max(1, rows.count()))

    def find(batches):
        for batch in batches:
            ids, starts, labels, codes = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base, spans = base_spans(text), candidates(text)
                laid = [(max(a, s - LEFT), min(b, s - LEFT + WIDTH)) for a, b in spans for s in places(a, b)]
                ids += [str(key)] * len(laid)
                starts += [a for a, _ in laid]
                labels += [int(any(a < e and s < b for s, _, e in base)) for a, b in laid]
                codes += [x.tobytes() for x in windows(text, spans)]
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(starts, pa.int64()), pa.array(labels, pa.int64()), pa.array(codes, pa.binary())], names=["id", "start", "label", "code"])

    found = rows.where(uniform("id") < rate).mapInArrow(find, "id string, start bigint, label bigint, code binary")
    found = found.groupBy("code").agg(F.max("label").alias("label"))
    pos = found.where("label = 1").orderBy(F.xxhash64("code"), "code").limit(most).toArrow()
    neg = found.where("label = 0").orderBy(F.xxhash64("code"), "code").limit(negatives * max(pos.num_rows, most // 10)).toArrow()
    rng = np.random.default_rng(seed)
    read = lambda t: np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(-1, WIDTH)
    own, others = read(pos), read(neg)
    x, y = labelled_windows(labelled(findings, seed, parts_but(calibration, *left_out)))
    if len(own) and len(others):
        bare = own[: (len(own) + 1) // 2].copy()
        bare[:, :LEFT] = others[rng.choice(len(others), len(bare))][:, :LEFT]
        own = np.concatenate((own, bare))
    seen, marks = np.concatenate([own, others]), np.concatenate([np.ones(len(own)), np.zeros(len(others))])
    held = rng.random(len(marks)) < 0.2
    net = _fit(np.concatenate([x, seen[~held]]), np.concatenate([y, marks[~held]]), epochs, rng)
    new, found = labelled_windows(labelled(max(200, findings // 4), seed + 1, (calibration,)))
    x, y = np.concatenate([new, seen[held]]), np.concatenate([found, marks[held]])
    net["scale"], net["shift"] = _platt(logits(net, x), y)
    hits = np.sort(probabilities(net, new[found == 1]))
    net["threshold"] = float(hits[int((1 - recall) * len(hits))])
    return net


def _fit(x: np.ndarray, y: np.ndarray, epochs: int, rng, decay: float = 0.01) -> dict:
    """Adam on cross-entropy with weight decay, classes weighted alike."""
    net = {
        "embed": rng.normal(0, 0.3, (2 * SYMBOLS, DIM)), "conv": rng.normal(0, 0.2, (TAPS * DIM, FILTERS)), "conv_bias": np.zeros(FILTERS),
        "out": rng.normal(0, 0.2, 2 * FILTERS), "out_bias": np.zeros(1),
    }
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    step, n = 0, WIDTH - TAPS + 1
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 64):
            own = order[i : i + 64]
            patches, h, best, pooled, z = _forward(net, x[own])
            dz = weight[own] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
            grad = {"out": pooled.T @ dz, "out_bias": np.array([dz.sum()])}
            dpool = dz[:, None] * net["out"]
            dh = np.zeros_like(h)
            np.put_along_axis(dh, best[:, None, :], dpool[:, None, :FILTERS], 1)
            dh[:, LEFT:] += dpool[:, None, FILTERS:] / (n - LEFT)
            dh *= h > 0
            grad["conv"] = patches.reshape(-1, TAPS * DIM).T @ dh.reshape(-1, FILTERS)
            grad["conv_bias"] = dh.sum(axis=(0, 1))
            dp = (dh @ net["conv"].T).reshape(len(own), n, TAPS, DIM)
            de = np.zeros((len(own), WIDTH, DIM))
            for t in range(TAPS):
                de[:, t : t + n] += dp[:, :, t]
            grad["embed"] = np.zeros_like(net["embed"])
            np.add.at(grad["embed"], x[own], de)
            step += 1
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net[k] = net[k] - 0.01 * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + decay * net[k])
    return net | {"scale": 1.0, "shift": 0.0, "threshold": 0.5}


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make the outputs probabilities, with the usual softened targets."""
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.stack([z, np.ones_like(z)], 1)

    def loss(w):
        v = a @ w
        return np.sum(np.logaddexp(0, v) - t * v) + 5e-4 * np.sum((w - [1, 0]) ** 2)

    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (p - t) + 1e-3 * (w - [1, 0]))
        size = 1.0  # halved until the loss falls: full Newton steps run off where outputs are far apart
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def spans_of(texts: list[str | None], net: dict | None) -> list[tuple[list, list]]:
    """(base, all) spans of each text. Base spans stay; accepted candidates that overlap none are added; a candidate's best window counts."""
    base = [base_spans(t) if t else [] for t in texts]
    out = [list(b) for b in base]
    if net:
        runs = [candidates(t) if t else [] for t in texts]
        x = [windows(t, r) for t, r in zip(texts, runs) if r]
        p = probabilities(net, np.concatenate(x)) if x else np.zeros(0)
        at = 0
        for n, own in enumerate(runs):
            for a, b in own:
                q = p[at : at + len(places(a, b))].max()
                if q >= net["threshold"] and not any(a < e and s < b for s, _, e in base[n]):
                    out[n].append((a, 3, b))
                at += len(places(a, b))
    return [(b, sorted(o)) for b, o in zip(base, out)]


def _listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, net: dict | None, keep=("doc_id",), text_col: str = "text", with_text: bool = True) -> DataFrame:
    """The columns in keep, n_assign, n_access, n_hex, base_sha256, spans and, with_text, redacted.

    Every whole text is scanned, of any length. Null and empty texts have no spans (redacted: null
    stays null). redacted is the text with every span, overlapping ones merged, replaced by
    [SECRET]. Repeated rows each give a row, an empty table an empty result, and without a network
    only base spans are found.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = NAMES if with_text else NAMES[:-1]

    def run(batches):
        for batch in batches:
            texts, rows = batch.column(len(keep)).to_pylist(), []
            for text, (base, found) in zip(texts, spans_of(texts, shared.value)):
                own = [k for _, k, _ in base]
                rows.append((own.count(0), own.count(1), own.count(2), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(found), *([redact(text, found)] if with_text else [])))
            types = [pa.int64()] * 3 + [pa.string()] * (len(names) - 3)
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), *(pa.array(list(c), t) for c, t in zip(cols, types))], names=[*keep, *names])

    head = "".join(f"`{k}` {kinds[k]}, " for k in keep)
    return docs.select(*keep, text_col).mapInArrow(run, head + ", ".join(f"{c} {'bigint' if c.startswith('n_') else 'string'}" for c in names))


NAMES = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]


def redact(text: str | None, spans: list, mark: str = "[SECRET]") -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])

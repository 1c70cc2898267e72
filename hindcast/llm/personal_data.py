"""Personal data by patterns and a skip-chain conditional random field.

Patterns find what is certain, the base spans. A conditional random field over the tokens of a
document that hold a digit or an ``@`` (all others are no personal data: their label is fixed) adds
what the patterns miss. Neighbours share a transition potential; distant tokens that are repeated or
similar (same text, or the same last seven digits) share a skip potential, so that a number written
in full once is also found where it is cut short. Labels of base tokens are fixed, the others follow
from loopy message passing over the whole document. Each repetition is linked with the one before
it, so a token that stands there a million times costs a million links.

The weights are learned from the base spans by pseudo-likelihood on a bounded sample of documents.
Half of the examples hide the exact shape of the token, so that context, neighbours and links count.
Tokens linked to a base token but not found themselves are left out: they are what is looked for.

NULL and empty texts have no spans. Each row is a document of its own, so repeated rows have equal
results; a NULL doc_id stays NULL. Without any base span in the sample nothing is added. Work and
memory are linear in the text. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
OTHER = 0  # label of what is no personal data; kind k has label k + 1
LABELS = len(KINDS) + 1
FEATURES = 1 << 14
NO_FEATURE = FEATURES  # a last row of zeros in the weights
SLOTS = 12
LINKS = ("chain", "same text", "same digits")
SURE = 0.9  # an added token needs this probability
ROUNDS = 20  # of message passing
AGREEMENT = 6.0  # prior mean of the reward for equal labels along a skip link

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_MARKED = re.compile(r"[0-9]+|@")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"[^A-Za-z0-9+(@]*(.*?)[^A-Za-z0-9@]*", re.DOTALL)


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match is settled by its @: the run of allowed characters before it, a domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find("@", at + 1)


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """IP addresses and cards; both begin with a run of digits, so only these are tried."""
    past_ip = past_card = 0
    for run in _DIGITS.finditer(text):
        start = run.start()
        if start >= past_ip and (m := _IP.match(text, start)):
            past_ip = m.end()
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                yield 1, start, past_ip
        if start >= past_card and (m := _CARD.match(text, start)):
            past_card = m.end()
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and passes_luhn(digits):
                yield 2, start, past_card


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    found = [(0, *span) for span in _emails(text)] if "@" in text else []
    found += sorted(_numbers(text))
    if "+" in text:
        found += [(3, *span) for span in _phones(text)]
    return found


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for k, start, end in spans)


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Runs without white space that hold a digit or an @."""
    past = 0
    for mark in _MARKED.finditer(text):
        at = mark.start()
        if at < past:
            continue
        width, start = 32, None
        while start is None:  # look back in growing steps, not further than the last token
            low = max(past, at - width)
            spaces = [m.end() for m in _SPACE.finditer(text, low, at)]
            if spaces or low == past:
                start = spaces[-1] if spaces else low
            width *= 4
        space = _SPACE.search(text, mark.end())
        past = space.start() if space else len(text)
        yield start, past


def _hashed(name: str, value: object) -> int:
    return zlib.crc32(f"{name}={value}".encode("utf-8", "surrogatepass")) % FEATURES


def _features(text: str, start: int, end: int) -> list[int]:
    """Ids of a token's features; the first three are the exact shape, hidden in half the examples."""
    token = text[start:end]
    digits = _NOT_DIGIT.sub("", token)
    n = len(digits)
    shape = _LETTERS.sub("a", _DIGITS.sub(lambda m: "9" * min(len(m.group()), 5), token))[:24]
    checked = "card" if 13 <= n <= 19 and passes_luhn(digits) else "long" if 13 <= n <= 19 else "-"
    core = _EDGE.fullmatch(token).group(1)
    parts = core.split(".")
    dotted = len(parts) == 4 and all(p.isdecimal() and p.isascii() for p in parts)
    if dotted:
        dotted = "fits" if all(len(p) < 4 and int(p) < 256 for p in parts) else "beyond"
    before, after = text[max(0, start - 40):start].split(), text[end:end + 40].split()
    return [
        _hashed("shape", shape), _hashed("checked", checked), _hashed("dotted", dotted),
        _hashed("bias", ""), _hashed("digits", min(n, 20)), _hashed("at", "@" in token),
        _hashed("letters", bool(_LETTERS.search(token))), _hashed("dots", min(token.count("."), 4)),
        _hashed("before", before[-1].lower() if before else ""),
        _hashed("before2", before[-2].lower() if len(before) > 1 else ""),
        _hashed("after", after[0].lower() if after else ""),
        _hashed("label", bool(before) and before[-1].endswith(":")),
    ]


@dataclass
class Graph:
    """Tokens and links of one document or, laid side by side, of many."""

    spans: np.ndarray  # start, end
    labels: np.ndarray  # of base tokens, -1 of the others
    features: np.ndarray
    sides: np.ndarray  # how many neighbours in the text are fixed to OTHER: left, right
    links: np.ndarray  # left token, right token, kind


def document_graph(text: str, base: list[tuple[int, int, int]]) -> Graph:
    spans = list(_tokens(text))
    n = len(spans)
    links, same, similar = [], {}, {}
    fixed = np.ones((n, 2), np.int64)
    for i, (start, end) in enumerate(spans):
        if i and start - spans[i - 1][1] == 1 and text[start - 1] != "\n":
            links.append((i - 1, i, 0))
            fixed[i - 1, 1] = fixed[i, 0] = 0
        core = _EDGE.fullmatch(text[start:end]).group(1).lower()
        digits = _NOT_DIGIT.sub("", core)
        if len(core) > 2:
            if core in same:
                links.append((same[core], i, 1))
            same[core] = i
        if len(digits) >= 7 and "@" not in core:
            last, seen = similar.get(digits[-7:], (None, None))
            if last is not None and seen != core:
                links.append((last, i, 2))
            similar[digits[-7:]] = i, core
    labels = np.full(n, -1, np.int64)
    if n and base:
        begin, stop = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
        for kind, start, end in reversed(base):  # of several kinds the first listed is kept
            labels[np.searchsorted(stop, start, "right"):np.searchsorted(begin, end)] = kind + 1
    return Graph(
        np.array(spans, np.int64).reshape(-1, 2), labels,
        np.array([_features(text, *s) for s in spans], np.int64).reshape(-1, SLOTS), fixed,
        np.array(links, np.int64).reshape(-1, 3))


def side_by_side(graphs: list[Graph]) -> Graph:
    offset, links = 0, []
    for g in graphs:
        links.append(g.links + np.array([offset, offset, 0]))
        offset += len(g.labels)
    return Graph(*(np.concatenate([getattr(g, f) for g in graphs])
                   for f in ("spans", "labels", "features", "sides")), np.concatenate(links))


@dataclass
class Model:
    """``unary`` per feature and label, ``pairs`` per kind of link and two labels."""

    unary: np.ndarray
    pairs: np.ndarray


def _local_scores(graph: Graph, model: Model) -> np.ndarray:
    chain = model.pairs[0]
    return (model.unary[graph.features].sum(1) + graph.sides[:, :1] * chain[OTHER]
            + graph.sides[:, 1:] * chain[:, OTHER])


def marginals(graph: Graph, model: Model, rounds: int = ROUNDS) -> np.ndarray:
    """Probability of each label of each token, by sum-product messages along all links.

    All messages are renewed at once, a fixed number of times, so documents laid side by side do not
    influence each other. Exact where the links of a document form no loop and are no longer than
    the rounds.
    """
    local = _local_scores(graph, model)
    local[graph.labels >= 0] = -1e9
    known = np.flatnonzero(graph.labels >= 0)
    local[known, graph.labels[known]] = 0.0
    left, right, kind = graph.links.T
    sender, receiver = np.concatenate([left, right]), np.concatenate([right, left])
    back = np.concatenate([np.arange(len(left)) + len(left), np.arange(len(left))])
    table = np.exp(np.concatenate([model.pairs[kind], model.pairs[kind].transpose(0, 2, 1)]))
    messages = np.zeros((len(sender), LABELS))

    def beliefs() -> np.ndarray:
        total = local.copy()
        for y in range(LABELS):
            total[:, y] += np.bincount(receiver, messages[:, y], len(local))
        return total

    for _ in range(rounds if len(sender) else 0):
        out = beliefs()[sender] - messages[back]
        out = np.exp(out - out.max(1, keepdims=True))
        fresh = np.log(np.einsum("ea,eab->eb", out, table) + 1e-300)
        fresh -= fresh.max(1, keepdims=True)
        messages = 0.5 * messages + 0.5 * fresh if len(graph.links) else fresh
    total = beliefs()
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


def fit(graph: Graph, steps: int = 250, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Pseudo-likelihood: every token given its features and the labels of its neighbours."""
    label = np.maximum(graph.labels, OTHER)
    left, right, kind = graph.links.T
    beside = np.zeros((len(label), 2 * len(LINKS), LABELS))  # labels of neighbours, by side and kind
    np.add.at(beside, (right, kind, label[left]), 1.0)
    np.add.at(beside, (left, len(LINKS) + kind, label[right]), 1.0)
    beside[:, 0, OTHER] += graph.sides[:, 0]
    beside[:, len(LINKS), OTHER] += graph.sides[:, 1]
    skip = beside.reshape(len(label), 2, len(LINKS), LABELS)[:, :, 1:].sum((1, 2))
    used = (graph.labels >= 0) | (skip[:, OTHER + 1:].sum(1) == 0)
    full, hidden = graph.features[used], graph.features[used].copy()
    hidden[:, :3] = NO_FEATURE
    ids = np.concatenate([full, hidden])
    near = np.concatenate([beside[used]] * 2)
    want = np.eye(LABELS)[np.concatenate([label[used]] * 2)]
    unary, pairs = np.zeros((FEATURES + 1, LABELS)), np.zeros((len(LINKS), LABELS, LABELS))
    prior = np.zeros_like(pairs)
    prior[1:] = AGREEMENT * np.eye(LABELS)
    pairs += prior
    model = Model(unary, pairs)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (unary, pairs)]
    flat = ids.ravel()
    for step in range(1, steps + 1 if len(ids) else 1):
        score = unary[ids].sum(1) + np.einsum("nka,kay->ny", near[:, :len(LINKS)], pairs)
        score += np.einsum("nkb,kyb->ny", near[:, len(LINKS):], pairs)
        p = np.exp(score - score.max(1, keepdims=True))
        error = p / p.sum(1, keepdims=True) - want
        error /= len(error)
        slope = np.stack([np.bincount(flat, np.repeat(error[:, y], SLOTS), FEATURES + 1)
                          for y in range(LABELS)], 1)
        slope[NO_FEATURE] = 0.0
        across = np.einsum("nka,ny->kay", near[:, :len(LINKS)], error)
        across += np.einsum("nkb,ny->kyb", near[:, len(LINKS):], error)
        # Skip links only reward agreement; the order of the two does not matter to them.
        across[1:] *= np.eye(LABELS)
        for value, mean, grad, (first, second) in zip(
                (unary, pairs), (0.0, prior), (slope, across), moments):
            grad = grad + penalty * (value - mean)
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            value -= rate * (first / (1 - 0.9 ** step)) / (
                np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return model


_PLAUSIBLE = {
    0: lambda s, n: 0 < s.find("@") < len(s) - 1, 1: lambda s, n: s.count(".") == 3 and n >= 4,
    2: lambda s, n: 12 <= n <= 19, 3: lambda s, n: 7 <= n <= 15,
}


def added_spans(text: str, graph: Graph, chance: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of neighbouring tokens that surely have one label and look like it in outline."""
    chosen = chance.argmax(1)
    sure = (chosen != OTHER) & (chance.max(1) >= SURE) & (graph.labels < 0)
    joined = {int(b) for a, b, kind in graph.links if kind == 0 and sure[a] and sure[b]
              and chosen[a] == chosen[b]}
    runs: list[list[int]] = []
    for i in np.flatnonzero(sure):
        if int(i) in joined:
            runs[-1].append(int(i))
        else:
            runs.append([int(i)])
    out = []
    for run in runs:
        start, end = int(graph.spans[run[0], 0]), int(graph.spans[run[-1], 1])
        m = _EDGE.fullmatch(text, start, end)
        kind, found = int(chosen[run[0]]) - 1, m.group(1)
        if _PLAUSIBLE[kind](found, len(_NOT_DIGIT.sub("", found))):
            out.append((kind, *m.span(1)))
    return out


def _examples(documents: DataFrame, documents_used: int, tokens_used: int) -> Graph | None:
    """Graphs of about ``documents_used`` different documents, chosen by the hash of id and text."""
    total = documents.count()
    share = min(1.0, documents_used / max(total, 1))
    border = int(share * 2 ** 63) - 1
    rows = documents.select(F.col("doc_id").cast("long"), "text").withColumn(
        "key", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    rows = rows.filter((F.col("key") <= border) & F.col("text").rlike("[0-9@]"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, columns = [], [[] for _ in range(4)]
            for text, key in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                if sum(1 for _ in zip(_tokens(text), range(tokens_used + 1))) > tokens_used:
                    continue
                g = document_graph(text, base_spans(text))
                keys.append(key)
                for column, part in zip(columns, (g.labels, g.features, g.sides, g.links)):
                    column.append(part.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k.as_py() for k in keys], pa.int64()),
                 *[pa.array(c, pa.binary()) for c in columns]],
                names=["key", "labels", "features", "sides", "links"])

    schema = "key long, labels binary, features binary, sides binary, links binary"
    found = rows.mapInArrow(parsed, schema).dropDuplicates(["key"]).collect()
    graphs = []
    for row in sorted(found, key=lambda r: r["key"]):
        labels, features, sides, links = (np.frombuffer(row[c], "<i8") for c in row.__fields__[1:])
        graphs.append(Graph(np.zeros((len(labels), 2), np.int64), labels,
                            features.reshape(-1, SLOTS), sides.reshape(-1, 2),
                            links.reshape(-1, 3)))
    return side_by_side(graphs) if graphs else None


def fit_model(documents: DataFrame, documents_used: int = 20_000,
              tokens_used: int = 200) -> Model | None:
    """The weights, from about ``documents_used`` documents of at most ``tokens_used`` tokens.

    Only the fit is bounded so; the model is then applied to all documents. None if there is no
    base span to learn from.
    """
    examples = _examples(documents, documents_used, tokens_used)
    if examples is None or not (examples.labels >= 0).any():
        return None
    return fit(examples)


def _found(texts: list[str], model: Model | None):
    """Base and added spans per text; the graphs of all texts pass messages together."""
    base = [base_spans(t) for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if model is not None:
        graphs = {i: document_graph(t, base[i]) for i, t in enumerate(texts) if _MARKED.search(t)}
        open_ones = [i for i, g in graphs.items() if (g.labels < 0).any()]
        if open_ones:
            chance = marginals(side_by_side([graphs[i] for i in open_ones]), model)
            begin = 0
            for i in open_ones:
                n = len(graphs[i].labels)
                added[i] = added_spans(texts[i], graphs[i], chance[begin:begin + n])
                begin += n
    return zip(base, added)


def personal_spans(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, base spans per kind, ``base_sha256``, ``spans`` (all) and ``n_added``. No shuffle."""
    slice_chars = 4_000_000  # texts whose graphs are laid side by side; not a bound on a text

    def slices(texts: list[str]) -> Iterator[list[str]]:
        part, size = [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size > slice_chars:
                yield part
                part, size = [], 0
        yield part

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for part in slices([t.as_py() or "" for t in batch.column(1)]):
                for base, added in _found(part, model):
                    written = _written(base)
                    rows.append((
                        *[sum(1 for s in base if s[0] == k) for k in range(len(KINDS))],
                        hashlib.sha256(written.encode()).hexdigest(),
                        _written(sorted(base + added)) if added else written, len(added)))
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types)]],
                names=["doc_id", *names])

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    schema = "doc_id long, " + ", ".join(
        f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(found, schema)


def find_personal_data(documents: DataFrame) -> DataFrame:
    return personal_spans(documents, fit_model(documents))

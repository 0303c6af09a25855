"""Personal data in free text: a skip-chain conditional random field.

A text becomes tokens; strings that could be an e-mail address, a phone or an identity number are one token
each.  A chain over each line scores labels from features of a token and its neighbours and from neighbouring
labels; skip edges join each occurrence of a word in a document with the ones before and after it, whatever their
case and accents, so that a name recognised by its surroundings in one place is recognised in the others.  Inference
alternates exact sums along the chains with messages along the skip edges.  The chain's weights are fitted by maximum
likelihood on a generated sample of bounded size (see ``pii_training``), the weight of the skip edges afterwards on a
held-out part of it, whose sentences and names the chain never saw.

A batch of documents is scored at once on arrays: what depends on a token alone (its contributions to its own and its
neighbours' scores, its folded form, whether a chain ends with it) is worked out once per distinct token and looked up
afterwards.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanloom.llm import pii_training
from scanloom.session import spread

LABELS = ("O", "BN", "IN", "BA", "IA", "E", "P", "D")
_KIND = {"name": ("BN", "IN"), "address": ("BA", "IA"), "email": ("E", "E"), "phone": ("P", "P"), "id": ("D", "D")}
TYPES = {"BN": "person_name", "BA": "street_address", "E": "email", "P": "phone", "D": "id_number"}
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
#: Weights of a skip edge that are tried, and rounds of messages.
SKIP_WEIGHTS, SKIP_ROUNDS = (0.0, 1.0, 2.0, 3.0, 4.0, 6.0), 2
#: Names are taken to be three times as rare in running text as in the sample, where nearly every other sentence has one.
NAME_PRIOR = math.log(1 / 3)
EPOCHS, PARTS = 10, 16
#: Share of a distinct token's features that a pass of training leaves out.
DROPPED = 0.3
KEPT_TYPES = 300_000

_AT = r"(?:[@＠]| ?(?:\[at\]|\(at\)|\{at\}|<at>) ?| at (?=[\w-]+ (?:\[dot\]|\(dot\)|dot) ))"
_DOT = r"(?:[.．]| ?(?:\[dot\]|\(dot\)|\{dot\}) ?| dot )"
_L, _R = r"(?<![\w@/.+-])", r"(?![\w@]|[-/.]\d)"

_ADDRESSES = (
    r"(?P<remote>(?>\w+)://[\w.+-]+@[\w.-]+[:/][\w./-]*|(?:(?>\w+)://)?\bgit@[\w.-]+(?:[:/][\w./-]*)?)",
    rf"(?P<email>(?>[\w.+%-]+)(?<=\w){_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}(?![\w@]))",
)
_NUMBERS = (
    rf"(?P<cpf>{_L}\d{{3}}[. ]\d{{3}}[. ]\d{{3}}[-/. ]\d{{2}}{_R})",
    rf"(?P<ssn>{_L}\d{{3}}(?:-\d{{2}}-| \d{{2}} )\d{{4}}{_R})",
    rf"(?P<nino>{_L}[A-Z]{{2}}(?: ?\d{{2}}){{3}} ?[A-Z]{_R})",
    rf"(?P<dni>{_L}(?:[XYZxyz]-?\d{{7,8}}|\d{{8}})(?:-?[A-Za-zÑñ]| [A-ZÑ]){_R})",
    rf"(?P<passport>{_L}[A-Z]{{1,2}}\d{{6,8}}{_R})",
    rf"(?P<nanp>{_L}(?:\+?1[-. ]?)?(?:\([2-9]\d{{2}}\) ?|[2-9]\d{{2}}[-. ])[2-9]\d{{2}}[-. ]\d{{4}}{_R}|{_L}\+1\d{{10}}{_R})",
    rf"(?P<uk>{_L}(?:\+44 ?(?:\(0\))? ?\d{{4}}|\(0\d{{4}}\)|0\d{{4}})[ -]?\d{{3}}[ -]?\d{{3}}{_R})",
    rf"(?P<es>{_L}(?:\(\+34\)|\+34|0034)[ -]?\d{{3}}[- ]?\d{{3}}[- ]?\d{{3}}{_R})",
    rf"(?P<br>{_L}(?:\+55 ?)?(?:\(0?\d{{2}}\) ?|0?\d{{2}}[ -])\d{{4,5}}[-. ]\d{{4}}{_R})",
    rf"(?P<intl>{_L}(?:\+|00)(?=[1-9])(?:\d{{1,3}}[ .-](?:\(?\d+\)?[ .-]?){{1,5}}\d|\d{{9,14}}){_R})",
    rf"(?P<triple>{_L}\d{{3}}(?:-\d{{3}}-| \d{{3}} |\.\d{{3}}\.)\d{{3}}{_R}|{_L}\d{{3}}(?: \d{{2}}){{3}}{_R})",
    rf"(?P<digits>{_L}\d{{9,11}}{_R})",
    r"(?P<groups>\d+(?:[-/.:]\d+)+)",
    r"(?P<house>\d+[A-Za-z]?\b)",
)
_PLAIN = (
    r"(?P<word>[^\W\d_]+(?:['’][^\W\d_]+)*)",
    r"(?P<mixed>\w+)",
    r"(?P<line>[\n\r\x0b\x0c\x85\u2028\u2029])",
    r"(?P<sign>\S)",
)
# Candidates, first match wins; the group's name is the class.  Texts without an at sign go without the first two.
_NUMERIC = r"(?=[+(\d]|[A-Z]{1,2} ?\d|[XYZxyz]-?\d)(?:" + "|".join(_NUMBERS) + ")"
_TOKEN = re.compile("|".join((*_ADDRESSES, _NUMERIC, *_PLAIN)))
_TOKEN_PLAIN = re.compile("|".join((_NUMERIC, *_PLAIN)))
_HAS_AT = re.compile(r"[@＠]|[\[({<]at[\])}>]| dot ")
_CANDIDATES = frozenset("email cpf ssn nino passport dni nanp uk es br intl triple digits".split())


def _bare(pattern: str) -> re.Pattern:
    """The pattern with blanks as matches of their own and without groups, so that its matches make up the whole text."""
    return re.compile(r"[^\S\n\r\x0b\x0c\x85\u2028\u2029]+|" + re.sub(r"\(\?P<\w+>", "(?:", pattern))


_PARTS, _PARTS_PLAIN = _bare(_TOKEN.pattern), _bare(_TOKEN_PLAIN.pattern)
_BREAKS = frozenset("\n\r\x0b\x0c\x85\u2028\u2029")


def _sort_of(part: str) -> str:
    """Class of a match that its characters alone tell; else ``?`` where its surroundings count."""
    if part.isspace():
        return "line" if part in _BREAKS else ""
    if len(part) == 1:
        return "word" if part.isalpha() else "?" if part.isalnum() or part == "_" else "sign"
    return "word" if part.replace("'", "").replace("\u2019", "").isalpha() else "?"


def tokens(text: str, sorts: dict[str, str] | None = None) -> list[tuple[str, int, int, str]]:
    """(token, start, end, class).  ``sorts`` keeps the classes of parts between calls."""
    whole = _HAS_AT.search(text) is not None
    match, sorts, out, at = (_TOKEN if whole else _TOKEN_PLAIN).match, {} if sorts is None else sorts, [], 0
    for part in (_PARTS if whole else _PARTS_PLAIN).findall(text):
        end = at + len(part)
        kind = sorts.get(part)
        if kind is None:
            kind = sorts[part] = _sort_of(part)
        if kind == "?":
            kind = match(text, at).lastgroup
        if kind:
            out.append((part, at, end, kind))
        at = end
    return out


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def token_key(token: str, kind: str) -> str:
    """What a token is looked up by; numbers and candidates by their class only."""
    if kind == "word":
        return token
    if kind in ("sign", "line"):
        return "\n" if kind == "line" else token
    if kind == "house":
        return f"\x01house{min(len(token), 5)}{token[-1].isalpha()}"
    if kind == "mixed":
        return "\x01mixed"
    if kind == "digits":
        return f"\x01digits{len(token)}"
    if kind == "ssn":
        return "\x01ssn"
    return f"\x01{kind}"


# Titles before a name, which are not part of it.
TITLES = frozenset("dr dra mr mrs ms miss sr sra srta dom don doña dona prof eng sir lady".split())


#: Everyday words and things, which no name consists of when uncapitalised.
_NO_NAMES = frozenset(w for ws in (*pii_training.WORDS.values(), pii_training.THINGS) for w in ws)
_GIVEN, _FAMILY = (frozenset(x.lower() for x in names) for names in (pii_training.Maker().given, pii_training.Maker().family))


def features(key: str) -> list[str]:
    if key[0] == "\x01" or not key[0].isalpha():
        return ["t=" + key] + (["cand"] if key[1:] in _CANDIDATES else [])
    low = key.lower()
    if key.isupper():
        shape = "X" if len(key) == 1 else "XX"
    elif key[0].isupper():
        shape = "Xx"
    else:
        shape = "x" if key.islower() else "xX"
    plain = _fold(key)
    lists = ["title"] if low in TITLES else ["street"] if low in pii_training.STREET_WORDS else ["common"] if low in pii_training.COMMON or low[:-1] in pii_training.COMMON and low.endswith("s") else ["given"] if low in _GIVEN else ["family"] if low in _FAMILY else ["unlisted"]
    out = [*lists, *(["listed" + shape + x for x in lists]), "w=" + low, "s=" + shape, "word", f"e3={plain[-3:]}", f"e4={plain[-4:]}", f"b4={plain[:4]}"]
    if shape in ("Xx", "XX"):
        out += [f"se3={shape}{plain[-3:]}", f"sb4={shape}{plain[:4]}"]
    if shape in ("Xx", "XX", "x") and len(key) > 4:
        out.append(f"long{shape}")
    return out


class Model:
    """Weights: feature → one row of [offset, label]; transitions between labels; weight of a skip edge."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, trans: np.ndarray, skip: float = 0.0) -> None:
        self.index, self.weights, self.trans, self.skip = index, weights, trans, skip

    def of_key(self, key: str) -> np.ndarray:
        ids = [i for f in features(key) if (i := self.index.get(f)) is not None]
        return self.weights[ids].sum(0) if ids else np.zeros(self.weights.shape[1:], np.float32)


def _allowed() -> np.ndarray:
    """0 where a label may follow another, else a large penalty: an inside label follows its own kind."""
    t = np.zeros((len(LABELS), len(LABELS)), np.float32)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                if a not in ("B" + b[1], b):
                    t[i, j] = -1e4
    return t


#: What a token's form rules out: an address is nothing but an address, a candidate number nothing but a phone or an identity
#: number; other tokens are neither, and those with digits are no name; a line's end is nothing.
_FORM_OF = {k: 1 if k == "email" else 2 for k in _CANDIDATES}
_FORM = np.zeros((5, len(LABELS)), np.float32)
for _n, _out in enumerate(("E P D", "BN IN BA IA P D", "BN IN BA IA E", "BN IN E P D", "BN IN BA IA E P D")):
    _FORM[_n, [LABELS.index(x) for x in _out.split()]] = -1e4
# A form that hardly anything else has speaks against no entity from the start, an address most: repositories and versions are other tokens.
_FORM[1, 0], _FORM = -20.0, np.vstack([_FORM, _FORM[2:3]])
_FORM[5, 0] = -6.0
_FORM_OF |= dict.fromkeys(("nanp", "uk", "es", "br", "cpf", "ssn"), 5)


def _form(key: str) -> int:
    return 4 if key == "\n" else 0 if key[0] != "\x01" else _FORM_OF.get(key[1:].rstrip("0123456789"), 3)


_START = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS], np.float32)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def chain_sums(node: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward and backward sums of padded chains [n, t, label] and the scaled node factors.

    fwd * bwd, normalised per position, is the marginal.
    """
    n, t, _ = node.shape
    factor = np.exp(node - node.max(2, keepdims=True))
    move = np.exp(trans)
    fwd, bwd = np.empty_like(factor), np.ones_like(factor)
    f = factor[:, 0] * np.exp(_START)
    fwd[:, 0] = f = f / f.sum(1, keepdims=True)
    for s in range(1, t):
        step = (f @ move) * factor[:, s]
        step /= step.sum(1, keepdims=True)
        f = np.where(mask[:, s, None], step, f)
        fwd[:, s] = f
    b = bwd[:, -1]
    for s in range(t - 2, -1, -1):
        step = (factor[:, s + 1] * b) @ move.T
        step /= step.sum(1, keepdims=True)
        b = np.where(mask[:, s + 1, None], step, 1.0)
        bwd[:, s] = b
    return fwd, bwd, factor


def chain_best(node: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best label sequence of padded chains."""
    n, t, k = node.shape
    score = node[:, 0] + _START
    back = np.zeros((n, t, k), np.int8)
    stay = np.arange(k, dtype=np.int8)
    for s in range(1, t):
        all_ = score[:, None, :] + trans.T
        live = mask[:, s, None]
        back[:, s] = np.where(live, all_.argmax(2), stay)
        score = np.where(live, all_.max(2) + node[:, s], score)
    out, rows = np.zeros((n, t), np.int8), np.arange(n)
    out[:, -1] = score.argmax(1)
    for s in range(t - 1, 0, -1):
        out[:, s - 1] = back[rows, s, out[:, s]]
    return out


def _chains(starts: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Token positions of chains, padded, in groups of like length: (positions [n, t], mask)."""
    first = np.flatnonzero(starts | np.r_[True, doc[1:] != doc[:-1]])
    lens = np.diff(np.r_[first, len(doc)])
    order = np.argsort(lens, kind="stable")
    out, at = [], 0
    while at < len(order):
        low = int(lens[order[at]])
        limit = max(low + 3, int(low * 1.4))
        end = int(np.searchsorted(lens[order], limit, "right"))
        end = min(end, at + max(1, 400_000 // limit))
        ids = order[at:end]
        t = int(lens[ids].max())
        pos = first[ids, None] + np.minimum(np.arange(t), lens[ids, None] - 1)
        out.append((pos, np.arange(t) < lens[ids, None]))
        at = end
    return out


_TYPE_OF = np.array([0, 1, 1, 2, 2, 3, 4, 5])
_SAME_TYPE = np.eye(6, dtype=np.float32)[_TYPE_OF]


class Types:
    """Distinct tokens, numbered, with what depends on a token alone."""

    def __init__(self, model: Model | None) -> None:
        self.model = model
        self.at: dict[str, int] = {}
        self.folds: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.facts: list[tuple] = []
        self.ready = 0

    def ids(self, keys: list[str]) -> np.ndarray:
        at = self.at
        for k in set(keys).difference(at):
            at[k] = len(self.facts)
            word = k[0].isalpha()
            fold = self.folds.setdefault(_fold(k), len(self.folds)) if word and len(k) > 1 and k.lower() not in _NO_NAMES else -1
            # form, folded word, capitalised, ends a line or field, full stop, ordinary word before a full stop
            self.facts.append((_form(k), fold, word and k[0].isupper(), k in ("\n", ";", "|", "{", "}"), k == ".", len(k) > 2 and k.islower()))
            if self.model:
                self.rows.append(self.model.of_key(k))
        out = np.fromiter(map(at.__getitem__, keys), np.int64, len(keys))
        if self.ready < len(self.facts):
            self.form, self.fold, self.capital, self.end, self.stop, self.plain = (np.array(c) for c in zip(*self.facts, strict=True))
            if self.model:
                self.table = np.stack(self.rows)
            self.newline = at.get("\n", -1)
            self.ready = len(self.facts)
        return out

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Where no entity can continue from the token before: at lines, after field separators and after full stops that end a sentence."""
        out = ids == self.newline
        out[1:] |= self.end[ids[:-1]]
        out[2:] |= self.stop[ids[1:-1]] & self.plain[ids[:-2]]
        return out

    def skip_links(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, position of the same word's next occurrence in the document) of all words of two letters or more that the
        document has twice, case and accents left aside, and capitalised at least once; everyday words have no links."""
        fold = self.fold[ids]
        at = np.flatnonzero(fold >= 0)
        key = doc[at] * (len(self.folds) + 1) + fold[at]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        named = np.zeros(len(first), bool)
        np.logical_or.at(named, group, self.capital[ids[at]].astype(bool))
        pair = np.flatnonzero((group[1:] == group[:-1]) & named[group[1:]]) if len(key) else np.zeros(0, np.int64)
        return at[pair], at[pair + 1]


def _chains(starts: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Token positions of chains, padded, in groups of like length: (positions [n, t], mask)."""
    first = np.flatnonzero(starts | np.r_[True, doc[1:] != doc[:-1]])
    lens = np.diff(np.r_[first, len(doc)])
    order = np.argsort(lens, kind="stable")
    out, at = [], 0
    while at < len(order):
        low = int(lens[order[at]])
        limit = max(low + 3, int(low * 1.4))
        end = int(np.searchsorted(lens[order], limit, "right"))
        end = min(end, at + max(1, 400_000 // limit))
        ids = order[at:end]
        t = int(lens[ids].max())
        pos = first[ids, None] + np.minimum(np.arange(t), lens[ids, None] - 1)
        out.append((pos, np.arange(t) < lens[ids, None]))
        at = end
    return out


class Tagger:
    def __init__(self, model: Model, skip: float | None = None, rounds: int = SKIP_ROUNDS) -> None:
        self.model, self.skip, self.rounds = model, model.skip if skip is None else skip, rounds
        self.trans = (model.trans + _allowed()).astype(np.float32)
        self.types, self.sorts = Types(model), {}

    def _scores(self, ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
        table = self.types.table
        node = _FORM[self.types.form[ids]]
        node[:, LABELS.index("BN")] += NAME_PRIOR
        for o, d in enumerate(OFFSETS):
            a, b = max(0, -d), len(ids) - max(0, d)  # positions n with n + d inside
            if a < b:
                same = doc[a:b] == doc[a + d : b + d]
                node[a:b] += np.where(same[:, None], table[ids[a + d : b + d], o], 0)
        return node

    def label(self, batch: list[list[str]]) -> list[np.ndarray]:
        """Label numbers of the tokens (given by their keys) of each document."""
        keys = [k for d in batch for k in d]
        if not keys:
            return [np.zeros(0, np.int8) for _ in batch]
        if len(self.types.facts) > KEPT_TYPES:
            self.types = Types(self.model)
        ids = self.types.ids(keys)
        doc = np.repeat(np.arange(len(batch)), [len(d) for d in batch])
        node = self._scores(ids, doc)
        chains = _chains(self.types.starts(ids), doc)
        here, there = self.types.skip_links(ids, doc)
        extra = np.zeros_like(node)
        if len(here) and self.skip:
            wanted = np.zeros(len(keys), bool)
            wanted[here] = wanted[there] = True
            parts = [(pos[rows], mask[rows]) for pos, mask in chains if (rows := wanted[pos].any(1)).any()]
            linked = np.flatnonzero(wanted)
            here, there = np.searchsorted(linked, here), np.searchsorted(linked, there)
            ahead, back = np.zeros((len(linked), 6), np.float32), np.zeros((len(linked), 6), np.float32)  # messages a token got from before and from behind
            marginal = np.zeros((len(keys), len(LABELS)), np.float32)
            for _ in range(self.rounds):
                for pos, mask in parts:
                    f, b, _ = chain_sums((node + extra)[pos], mask, self.trans)
                    marginal[pos[mask]] = (f * b)[mask]
                belief = marginal[linked] @ _SAME_TYPE
                own = np.log(np.maximum(belief / belief.sum(1, keepdims=True), 1e-12)) - ahead - back  # what a token believes by its chain
                new_ahead, new_back = np.zeros_like(ahead), np.zeros_like(back)
                new_ahead[there] = _potts((own + ahead)[here], self.skip)
                new_back[here] = _potts((own + back)[there], self.skip)
                ahead, back = new_ahead, new_back
                extra[linked] = (ahead + back)[:, _TYPE_OF]
        out = np.zeros(len(keys), np.int8)
        node += extra
        for pos, mask in chains:
            out[pos[mask]] = chain_best(node[pos], mask, self.trans)[mask]
        return np.split(out, np.cumsum([len(d) for d in batch])[:-1])


def _potts(belief: np.ndarray, weight: float) -> np.ndarray:
    """Message along an edge that favours equal types: sums over the sender's type."""
    belief = belief - belief.max(1, keepdims=True)
    p = np.exp(belief)
    return np.log1p((np.exp(weight) - 1) * p / p.sum(1, keepdims=True))


def _sample(docs: list) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    keys, gold, doc = [], [], []
    number = {x: n for n, x in enumerate(LABELS)}
    for d, (text, spans) in enumerate(docs):
        toks = tokens(text)
        at = 0
        for tok, a, _, kind in toks:
            while at < len(spans) and spans[at][1] <= a:
                at += 1
            label = "O"
            if at < len(spans) and spans[at][0] <= a:
                x, _, k = spans[at]
                first, inside = _KIND[k]
                label = first if a == x else inside
                if k in ("email", "phone", "id") and (kind not in _CANDIDATES or a != x):
                    label = "O"
            keys.append(token_key(tok, kind))
            gold.append(number[label])
            doc.append(d)
    types = Types(None)
    return keys, np.array(gold), np.array(doc), types.starts(types.ids(keys))


def train(sentences: int = pii_training.SENTENCES, epochs: int = EPOCHS, seed: int = 7, rate: float = 0.25, decay: float = 1e-6, parts: int = PARTS) -> Model:
    """Maximum likelihood of the chain on the generated sample, by AdaGrad over parts of the sample."""
    docs = pii_training.Maker(seed).documents(sentences)
    samples = [_sample(docs[n::parts]) for n in range(parts)]
    per_key = {k: features(k) for keys, *_ in samples for k in keys}
    counts: dict[str, int] = {}
    for keys, *_ in samples:
        for k in keys:
            for f in per_key[k]:
                counts[f] = counts.get(f, 0) + 1
    index = {f: n for n, f in enumerate(f for f, c in counts.items() if c > 2)}
    k = len(LABELS)
    weights, trans = np.zeros((len(index), len(OFFSETS), k)), np.zeros((k, k))
    grad_sum, trans_sum = np.full_like(weights, 1e-8), np.full_like(trans, 1e-8)
    allowed = _allowed()

    prepared = []
    for keys, gold, doc, starts in samples:
        types = {x: n for n, x in enumerate(dict.fromkeys(keys))}
        pt, pf = (np.array(x) for x in zip(*[(n, index[f]) for x, n in types.items() for f in per_key[x] if f in index], strict=True))
        near = []
        for d in OFFSETS:
            a, b = max(0, -d), len(keys) - max(0, d)
            near.append(np.flatnonzero(doc[a:b] == doc[a + d : b + d]) + a)
        form = _FORM[[_form(x) for x in types]]
        prepared.append((np.array([types[x] for x in keys]), len(types), pt, pf, near, np.eye(k)[gold], gold, _chains(starts, doc), form))

    # in each pass over a part some features of each distinct token are left out, so that words not seen before are met by
    # their shape and place
    drop = np.random.default_rng(seed)
    kinds = np.array([f.startswith(("t=", "s=", "listed")) or f in ("word", "cand", "title", "street", "common", "given", "family", "unlisted") for f in index])
    for _ in range(epochs):
        for ids, n_types, pt, pf, near, one_hot, gold, chains, form in prepared:
            table = np.zeros((n_types, len(OFFSETS), k))
            kept = kinds[pf] | (drop.random(len(pf)) > DROPPED) & (drop.random(n_types) > DROPPED / 2)[pt]
            pt, pf = pt[kept], pf[kept]
            np.add.at(table, pt, weights[pf])
            node = form[ids].astype(float)
            for o, d in enumerate(OFFSETS):
                node[near[o]] += table[ids[near[o] + d], o]
            full = trans + allowed
            move, expect, t_grad = np.exp(full), np.zeros_like(node), np.zeros_like(trans)
            for pos, mask in chains:
                f, b, factor = chain_sums(node[pos], mask, full)
                p = f * b
                expect[pos[mask]] = (p / p.sum(2, keepdims=True))[mask]
                if pos.shape[1] > 1:
                    edge = f[:, :-1, :, None] * move * (factor[:, 1:] * b[:, 1:])[:, :, None, :]
                    t_grad -= (edge / edge.sum((2, 3), keepdims=True) * mask[:, 1:, None, None]).sum((0, 1))
                    np.add.at(t_grad, (gold[pos[:, :-1]][mask[:, 1:]], gold[pos[:, 1:]][mask[:, 1:]]), 1)
            diff = one_hot - expect
            by_type = np.zeros((n_types, len(OFFSETS), k))
            for o, d in enumerate(OFFSETS):
                for j in range(k):
                    by_type[:, o, j] = np.bincount(ids[near[o] + d], diff[near[o], j], n_types)
            grad = np.zeros_like(weights)
            np.add.at(grad, pf, by_type[pt])
            grad = grad / len(ids) - decay * weights
            t_grad /= len(ids)
            grad_sum += grad**2
            trans_sum += t_grad**2
            weights += rate * grad / np.sqrt(grad_sum)
            trans += rate * t_grad / np.sqrt(trans_sum)
    return Model(index, weights.astype(np.float32), trans.astype(np.float32))


def errors(m: Model, docs: list, skip: float) -> int:
    """Entities of labelled documents that are missed or found where there are none, by type and start."""
    found = find(Tagger(m, skip), [text for text, _ in docs])
    names = {"name": "person_name", "address": "street_address", "email": "email", "phone": "phone", "id": "id_number"}
    return sum(len({(k, a) for k, a, _ in f} ^ {(names[k], a) for a, _, k in spans}) for f, (_, spans) in zip(found, docs, strict=True))


@lru_cache(2)
def model(sentences: int = pii_training.SENTENCES) -> Model:
    """The chain fitted on the sample, the skip edges' weight the one with the fewest errors on the held-out part (the least of equals)."""
    m = train(sentences)
    held = pii_training.Maker(11, held=True).documents(min(sentences, pii_training.HELD_SENTENCES))
    m.skip = min(SKIP_WEIGHTS, key=lambda w: (errors(m, held, w), w))
    return m


_PARTICLES = frozenset(w for p in pii_training.PARTICLES for w in p.split()) | {"e", "y", "al", "bin", "ter", "ten", "le"}


def _name_part(run: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """The run up to what no name holds: words, hyphens, one comma, and full stops after initials, single blanks between;
    its words, particles apart, all begin with a capital or none does."""
    commas, capital = 0, None
    for n, (tok, a, _, kind) in enumerate(run):
        gap = a - run[n - 1][2] if n else 0
        commas += tok == ","
        before = run[n - 1][0] if n else ""
        if kind != "word" and tok not in (",", "-", ".", "‐", "‑") or gap > 1 or commas > 1:
            return run[:n]
        if tok == "." and not (len(before) == 1 and before.isalpha()) or before in (".", ",") and not gap:
            return run[:n]
        if kind == "word" and tok.lower() not in _PARTICLES:
            if capital is not None and capital != tok[0].isupper():
                return run[:n]
            capital = tok[0].isupper()
    return run


def entities(toks: list[tuple[str, int, int, str]], labels: np.ndarray) -> list[tuple[str, int, int]]:
    """(type, start, end) of labelled runs.  A name needs two parts (a hyphen makes none), an address a number and a kind of street."""
    out, n = [], 0
    while n < len(toks):
        x = LABELS[labels[n]]
        if x == "O":
            n += 1
            continue
        end = n + 1
        if x[0] == "B":
            while end < len(toks) and LABELS[labels[end]] == "I" + x[1]:
                end += 1
            run = toks[n:end]
            while run and run[0][0].lower() in TITLES or (run and run[0][0] in ".,"):
                run = run[1:]
            if x == "BN":
                run = _name_part(run)
            while run and (run[-1][3] == "sign" or x == "BN" and run[-1][0] in _PARTICLES):
                run = run[:-1]
            words = [t for t in run if t[3] == "word"]
            if x == "BA" and not any(w[0].lower() in pii_training.STREET_WORDS or w[0].lower() in ("row", "way", "place", "close") for w in words):
                words = []
            parts = sum(w[1] == run[0][1] or run[run.index(w) - 1][0] not in ("-", "‐", "‑") for w in words)
            if x == "BN" and words and words[0][0].islower() and any(w[0] in _NO_NAMES and w[0] not in _PARTICLES for w in words):
                words = []  # an uncapitalised run with an everyday word in it
            if x == "BN" and parts > 1 and any(len(w[0]) > 1 for w in words) or x == "BA" and words and any(t[3] in ("house", "groups", "mixed") for t in run):
                out.append((TYPES[x], run[0][1], run[-1][2]))
        elif x in TYPES and toks[n][3] in _CANDIDATES:
            out.append((TYPES[x], toks[n][1], toks[n][2]))
        n = end
    return out


def find(tagger: Tagger, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
    toks = [tokens(t, tagger.sorts) if t else [] for t in texts]
    if len(tagger.sorts) > KEPT_TYPES:
        tagger.sorts.clear()
    labels = tagger.label([[t[0] if t[3] == "word" else token_key(t[0], t[3]) for t in d] for d in toks])
    return [entities(t, y) if y.any() else [] for t, y in zip(toks, labels, strict=True)]


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """Each entity replaced by a placeholder of its type, the rest untouched."""
    out, at = [], 0
    for kind, a, b in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


#: Documents that are labelled together, and characters that end a group early.
GROUP_DOCS, GROUP_CHARS = 512, 600_000


def _groups(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str | None]]]:
    a, b, size = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        a.append(i)
        b.append(t)
        size += len(t or "")
        if len(a) >= GROUP_DOCS or size > GROUP_CHARS:
            yield a, b
            a, b, size = [], [], 0
    if a:
        yield a, b


def personal_data(docs: DataFrame, sentences: int = pii_training.SENTENCES) -> DataFrame:
    """doc_id, pii_type, start_pos, end_pos, count_order: one row per occurrence (start from 1, end inclusive).

    Null, empty and blank texts have none; texts are searched whole however long; repeated doc_ids give the
    union of their rows; other columns are ignored; an empty table gives no rows.  The model is fitted once per
    session on ``sentences`` generated sentences and travels with the tasks (a few megabytes, whatever the data).
    """
    fitted = docs.sparkSession.sparkContext.broadcast(model(sentences))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(fitted.value)
        for b in batches:
            rows = []
            for ids, texts in _groups(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, found in zip(ids, find(tagger, texts), strict=True):
                    rows += [(i, k, x + 1, y) for k, x, y in found]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "pii_type", "start_pos", "end_pos"])

    return spread(docs.where("text is not null and text <> ''").select("doc_id", "text")).mapInArrow(run, "doc_id long, pii_type string, start_pos long, end_pos long")


def redacted(docs: DataFrame, sentences: int = pii_training.SENTENCES) -> DataFrame:
    """doc_id, text with each entity replaced by its type's placeholder; null stays null."""
    fitted = docs.sparkSession.sparkContext.broadcast(model(sentences))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(fitted.value)
        for b in batches:
            out_ids, out = [], []
            for ids, texts in _groups(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out_ids += ids
                out += [None if t is None else redact(t, f) for t, f in zip(texts, find(tagger, texts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return spread(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, text string")

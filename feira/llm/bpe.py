"""BPE encoding and decoding with a tokenization automaton.

The automaton's states are the tokens last read (and a start state); an arc is a
token that may follow. It is built by merge gadgets, one per merge in rank order:
for the merge (u, v), the state that u-arcs enter is split off and loses its
v-arcs, and every state with a u-arc to it gains a uv-arc to where v led. All
arcs of one token enter one state, so each gadget changes the arcs of a single
state, and whether t may be followed by w after all gadgets is settled by the
gadgets that made t and w and the one, if any, that merges them.

The automaton is compiled to flat sorted tables: (node, letter) -> node of the tree
that spells tokens from their last letter back, and (state, token) -> may it follow.
The second has as many entries as there are pairs of tokens, so an entry is filled
in by the gadgets when a text first asks for it, and is kept.

Every prefix of a word has exactly one correct tokenization, hence one state, the
last token of it. So a word is read by a deterministic walk, letter by letter and
without a step back: the state after a letter is the one token that ends there and
may follow the state where it begins. All new words of a batch take each step
together, in NumPy. Decoding emits the labels of the arcs. Words are pre-split by
the tokenizer's own pattern, after its normaliser.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .common import with_columns

WORD_END = "</w>"
#: Marks a special token among the runs; white space, so no run begins with it.
SPECIAL = "\n"
#: Bytes that Python's split() takes for white space but the tokenizer does not.
_CONTROL = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Automaton:
    """Tokenization automaton of a BPE vocabulary with its merges in rank order."""

    START = -1
    #: Entries kept of unfinished automata; beyond it they are computed again.
    PARTIAL = 400_000

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.label = {i: t for t, i in vocab.items()}
        made: dict[int, tuple[int, int, int]] = {}  # token -> the rank, left and right of its gadget
        self.joined: dict[tuple[int, int], int] = {}  # pair -> rank of the gadget that merges it
        for rank, (left, right) in enumerate(merges):
            u, v, uv = vocab[left], vocab[right], vocab[left + right]
            self.joined.setdefault((u, v), rank)
            made.setdefault(uv, (rank, u, v))
        self.made = made
        self.live: dict[int, bool] = {}
        self.partial: dict[tuple[int, int, int], bool] = {}  # arcs of the automaton before the last gadget
        self.size = 1 + max(vocab.values())
        # the table's keys (the last is above all others) and entries, and those not yet sorted in
        self.pairs, self.may = np.array([np.iinfo(np.int64).max]), np.zeros(1, bool)
        self.fresh: dict[int, bool] = {}
        self._spell(vocab)

    def _spell(self, vocab: dict[str, int]) -> None:
        """Compile the tree that spells tokens from the last letter back. A word's
        last letter, with the word end, is a letter of its own."""
        self.letters: dict[str, int] = {}
        edges: dict[tuple[int, int], int] = {}
        at: list[int] = [-1]
        for token, i in vocab.items():
            node = 0
            for letter in reversed(self.split(token)):
                edge = (node, self.letters.setdefault(letter, len(self.letters)))
                node = edges.setdefault(edge, len(at))
                if node == len(at):
                    at.append(-1)
            at[node] = i
        self.edges, self.token_at = edges, at
        self.width = len(self.letters) + 1  # one more for letters of no token
        keys = np.fromiter((n * self.width + x for n, x in edges), np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order]
        self.ends = np.array(at, np.int64)

    @staticmethod
    def split(token: str) -> list[str]:
        """The letters of a token or word; the word end belongs to the last one."""
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            token = token[:-len(WORD_END)]
            return [*token[:-1], token[-1] + WORD_END]
        return list(token)

    def arc(self, t: int, w: int, upto: int = 1 << 60) -> bool:
        """Has the state after t a w-arc once the gadgets of rank below upto are in?"""
        key = (t, w, upto)
        found = self.partial.get(key)
        if found is None:
            found = self._arc(t, w, upto)
            if len(self.partial) >= self.PARTIAL:
                self.partial.clear()
            self.partial[key] = found
        return found

    def _arc(self, t: int, w: int, upto: int) -> bool:
        cut = self.joined.get((t, w))
        t_rank, w_rank = self.rank(t), self.rank(w)
        if cut is not None and max(t_rank, w_rank) < cut < upto:
            return False  # this gadget took the w-arc from the state after t
        if t_rank < 0 and w_rank < 0:
            return True
        if w_rank > t_rank:
            # the gadget of w, if it found a path to join, gave w-arcs to the states that
            # have an arc for its left part (after it took arcs away: of "uuu", the
            # first two are joined)
            return self._whole(w) and self.arc(t, self.made[w][1], w_rank + 1)
        if t == w:  # the gadget's new arc enters the state as it was before the split
            return self.arc(self.made[t][2], self.made[t][1], t_rank)
        return self.arc(self.made[t][2], w, t_rank)  # the state after t began as that after its right part

    def rank(self, t: int) -> int:
        return self.made[t][0] if t in self.made else -1

    def follows(self, t: int, w: int) -> bool:
        """The entry (t, w) of the finished table."""
        return w not in self.made or self._whole(w) if t == self.START else self.arc(t, w)

    def _follow(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Entries (t, w) of the table, those not met before filled in."""
        keys = (t + 1) * self.size + w
        at = np.searchsorted(self.pairs, keys)
        known = self.pairs[at] == keys
        may = self.may[at]
        if not known.all():
            for k in (new := np.unique(keys[~known])).tolist():
                if k not in self.fresh:
                    self.fresh[k] = self.follows(k // self.size - 1, k % self.size)
            found = np.fromiter(map(self.fresh.__getitem__, new.tolist()), bool, len(new))
            may[~known] = found[np.searchsorted(new, keys[~known])]
        return may

    def _settle(self) -> None:
        """Sort the entries found since into the table."""
        if self.fresh:
            keys = np.concatenate([self.pairs, np.fromiter(self.fresh, np.int64, len(self.fresh))])
            order = np.argsort(keys)
            self.pairs, self.may = keys[order], np.concatenate([self.may, np.fromiter(self.fresh.values(), bool, len(self.fresh))])[order]
            self.fresh = {}

    def _whole(self, w: int) -> bool:
        """Did the gadget of w find a path? Only then does any state have a w-arc, and
        only then do w's own letters give w."""
        if w not in self.made:
            return True
        found = self.live.get(w)
        if found is None:
            rank, u, v = self.made[w]
            found = self.live[w] = self._whole(u) and self._whole(v) and self.arc(u, v, rank)
        return found

    def encode(self, word: list[str]) -> list[int]:
        """Token ids of one word, given as its letters: the walk, step by step."""
        last, back = [self.START], [0]  # state after each letter, length of its last token
        for i in range(len(word)):
            node, k = 0, 0
            while True:
                node = self.edges.get((node, self.letters.get(word[i - k], -1))) if k <= i else None
                if node is None:
                    raise ValueError("a letter is not in the vocabulary")
                k, t = k + 1, self.token_at[node]
                if t >= 0 and self.follows(last[i + 1 - k], t):
                    break
            last.append(t)
            back.append(k)
        ids, i = [], len(word)
        while i:
            ids.append(last[i])
            i -= back[i]
        return ids[::-1]

    def encode_all(self, letters: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of many words one after another, and how many each has; the words
        are given as numbers of letters one after another. All walk together."""
        before = np.cumsum(lens) - lens  # where each word's first letter is
        order = np.argsort(-lens, kind="stable")
        first, size = before[order], -lens[order]
        last, back = np.full(len(letters), self.START, np.int64), np.zeros(len(letters), np.int64)
        for i in range(-int(size[0]) if len(size) else 0):
            end, k = first[:np.searchsorted(size, -i)] + i, 0  # in words of more than i letters
            node = np.zeros(len(end), np.int64)
            while len(end):
                if k > i:
                    raise ValueError("a letter is not in the vocabulary")
                key = node * self.width + letters[end - k]
                at = np.minimum(np.searchsorted(self.edge_keys, key), len(self.edge_keys) - 1)
                if (self.edge_keys[at] != key).any():
                    raise ValueError("a letter is not in the vocabulary")
                node, k = self.edge_to[at], k + 1
                t = self.ends[node]
                ok = t >= 0
                state = last[end[ok] - k] if k <= i else np.full(ok.sum(), self.START)
                ok[ok] = self._follow(state, t[ok])
                last[end[ok]], back[end[ok]] = t[ok], k
                end, node = end[~ok], node[~ok]
        self._settle()
        at, own = np.zeros(len(letters), bool), np.arange(len(lens))
        count, end = np.zeros(len(lens), np.int64), before + lens - 1
        while len(end):  # back along every word's tokens
            at[end] = True
            count[own] += 1
            end = end - back[end]
            left = end >= before[own]
            end, own = end[left], own[left]
        return last[at], count


def _gather(values: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The stretches of values that begin at start and have these lengths, one after another."""
    shift = start - (np.cumsum(lens) - lens)
    return values[np.repeat(shift, lens) + np.arange(int(lens.sum()))]


class _Kept:
    """Token ids by string, up to so many bytes (entry: what one takes beside its
    string and ids); when it is full, it starts anew."""

    def __init__(self, most: int = 128 << 20, entry: int = 200):
        self.most, self.entry = most, entry
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.bytes, self.ids = 0, np.empty(0, np.int32)
        self.start, self.lens = np.empty(0, np.int64), np.empty(0, np.int64)

    def put(self, keys: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        """Add a batch of keys that are not there yet."""
        self.start = np.concatenate([self.start, np.cumsum(lens) - lens + len(self.ids)])
        self.lens, self.ids = np.concatenate([self.lens, lens]), np.concatenate([self.ids, ids.astype(np.int32)])
        self.number.update(zip(keys, range(len(self.number), len(self.number) + len(keys))))
        self.bytes += self.entry * len(keys) + sum(map(len, keys)) + 4 * len(ids)


class WordBPE:
    """A lower-casing BPE tokenizer with word ends, as its public JSON file says."""

    #: Longer words walk alone.
    LONG = 200

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.letters = byte_letters()
        number = self.automaton.letters
        self.inner = np.array([number.get(x, len(number)) for x in self.letters])
        self.final = np.array([number.get(x + WORD_END, len(number)) for x in self.letters])
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label = self.automaton.label | {i: t for t, i in self.added.items()}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.space = regex.compile(r"\s+")
        self.kept = _Kept()
        # all labels, each with a space after it, one after another
        spelled = [(self.label.get(i, "") + " ").encode() for i in range(1 + max(self.label))]
        self.label_lens = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.label_start, self.label_bytes = np.cumsum(self.label_lens) - self.label_lens, np.frombuffer(b"".join(spelled), np.uint8)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-split words one after another, and how many each has."""
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        letters = np.frombuffer(b"".join(raw), np.uint8)
        final = np.cumsum(lens) - 1
        number = self.inner[letters]
        number[final] = self.final[letters[final]]
        long = lens > self.LONG
        if not long.any():
            return self.automaton.encode_all(number, lens)
        ids, count = self.automaton.encode_all(number[np.repeat(~long, lens)], lens[~long])
        apart = iter(np.split(ids, np.cumsum(count)[:-1]))
        out = [self._alone(w) if far else next(apart) for w, far in zip(raw, long)]
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def _alone(self, word: bytes) -> np.ndarray:
        x = [self.letters[b] for b in word]
        return np.array(self.automaton.encode([*x[:-1], x[-1] + WORD_END]), np.int64)

    def _meet(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs without white space."""
        parts = list(map(self.split.findall, chunks))
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(w, len(number)) for p in parts for w in p), np.int64, int(n.sum()))
        if not number:
            return np.empty(0, np.int64), np.zeros(len(chunks), np.int64)
        ids, count = self._learn(list(number))
        lens = np.concatenate([[0], np.cumsum(count[which])])
        ends = np.concatenate([[0], np.cumsum(n)])
        return _gather(ids, (np.cumsum(count) - count)[which], count[which]), lens[ends[1:]] - lens[ends[:-1]]

    def _pieces(self, text: str) -> list[str]:
        """Runs without white space, normalised, and special tokens."""
        if self.specials and "<|" in text:
            return [x for piece in self.specials.split(text) for x in ([SPECIAL + piece] if piece in self.added else self._plain(piece))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case is taken by character, so never the final form
                text = text.replace("Σ", "σ")
        text = text.lower()
        return [x for x in self.space.split(text) if x] if _CONTROL.search(text) else text.split()

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and how many each has."""
        pieces, kept = [self._pieces(t) for t in texts], self.kept
        if kept.bytes > kept.most:
            kept.clear()
        new = set().union(*pieces).difference(kept.number)
        if new:
            special, plain = [x for x in new if x[0] == SPECIAL], [x for x in new if x[0] != SPECIAL]
            ids, lens = self._meet(plain)
            own = np.array([self.added[x[1:]] for x in special], np.int64)
            kept.put(plain + special, np.concatenate([ids, own]), np.concatenate([lens, np.ones(len(own), np.int64)]))
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        which = np.fromiter((k for p in pieces for k in map(kept.number.__getitem__, p)), np.int64, int(n.sum()))
        lens = kept.lens[which]
        upto, ends = np.concatenate([[0], np.cumsum(lens)]), np.concatenate([[0], np.cumsum(n)])
        return _gather(kept.ids, kept.start[which], lens), upto[ends[1:]] - upto[ends[:-1]]

    def labels(self, ids: np.ndarray, count: np.ndarray) -> Iterator[bytes]:
        """The decoded texts in UTF-8: labels of the arcs, joined by spaces (the file
        names no decoder)."""
        lens = self.label_lens[ids]
        data = memoryview(_gather(self.label_bytes, self.label_start[ids], lens))
        upto = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(count)])].tolist()
        return (data[a:max(a, b - 1)] for a, b in zip(upto, upto[1:]))

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, joined by spaces (the file names no decoder)."""
        return " ".join(self.label[i] for i in ids if i in self.label)


#: Characters of the texts that are encoded together.
PART = 1 << 22


def _parts(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters; a longer text is a range of its own."""
    a, total = 0, 0
    for i, t in enumerate(texts):
        if total + len(t) > most and i > a:
            yield a, i
            a, total = i, 0
        total += len(t)
    if a < len(texts):
        yield a, len(texts)


_LOADED: dict[str, WordBPE] = {}


def _load(name: str) -> WordBPE:
    if name not in _LOADED:
        _LOADED[name] = WordBPE(SparkFiles.get(name))
    return _LOADED[name]


def bpe(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text (null:
    empty); with keep_ids also ids (array of int) and decoded.

    vocabulary: path of the tokenizer's JSON file on the driver; Spark sends it to
    the executors. Each worker keeps caches of words, bounded in bytes. Rows are
    independent, so repeated ids and null ids pass through; extra columns are
    ignored. Special tokens written in a text get their own ids.
    """
    spark = docs.sparkSession
    if not any(p.rsplit("/", 1)[-1] == vocabulary.rsplit("/", 1)[-1] for p in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _load(name)
        for batch in batches:
            n, a, b, ids, decoded = [], [], [], [], []
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for i, j in _parts(texts, PART):
                got, count = t.encode_texts(texts[i:j])
                raw, upto = memoryview(got.astype("<u4")), np.concatenate([[0], np.cumsum(count)]).tolist()
                own = [raw[x:y] for x, y in zip(upto, upto[1:])]
                n += count.tolist()
                a += [hashlib.sha256(x).hexdigest() for x in own]
                for out in t.labels(got, count):
                    b.append(hashlib.sha256(out).hexdigest())
                    if keep_ids:
                        decoded.append(bytes(out).decode())
                if keep_ids:
                    ids += [x.tolist() for x in own]
            cols = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if keep_ids:
                cols |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return with_columns(docs, {"doc_id": "long", "text": "string"}).mapInArrow(encode, schema)

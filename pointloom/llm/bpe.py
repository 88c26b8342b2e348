"""Byte-pair encoding by speculation: longest matches are proposed, adjacent pairs checked, and only failing words merged.

A word's tokens are its encoding exactly when every adjacent pair of them is the encoding of their concatenation.
So the longest matches of all new words of a batch are looked up as pairs in one sorted table of known answers;
a word whose pairs all hold is done, any other goes through the merges in order of rank.

Texts are cut as the vocabulary file says. Null and empty texts have no tokens. Added tokens found in a text stand for themselves.
"""

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pointloom.llm.arrowtext import slices

END = "</w>"
CACHED_WORDS = 300_000
#: Characters that composition and lower-casing treat alike in every version of Unicode; other texts take the library's own normaliser.
_PLAIN = regex.compile("[^\\x00-ɏ‐-‧‰-⁞€™]")
_loaded: dict[str, "Encoder"] = {}


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        assert model["type"] == "BPE" and model["end_of_word_suffix"] == END and spec["decoder"] is None
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        self.letters = _byte_letters()
        self.table = {b: x for b, x in enumerate(self.letters)}
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", "\\p{White_Space}"))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.added.items()}
        self.added_cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")
        # A lone letter needs no check; any other token must be its own encoding.
        self.pairs, self.holds = np.zeros(0, np.int64), np.zeros(0, bool)
        self.clear()
        self.merged_words = 0

    def clear(self):
        self.counts: dict[str, int] = {}
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def symbols(self, word: str) -> list[str]:
        """The letters of a byte-level word; the last bears the end mark."""
        return [*word[:-1], word[-1] + END]

    def merge(self, symbols: list[str]) -> list[str]:
        """The merges in order of rank, then from the left."""
        n, part = len(symbols), list(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or part[i] != a or part[j] != b:
                continue
            part[i], part[j], after[i] = a + b, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (r := self.ranks.get((part[i], part[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[after[i]]))
            if (k := before[i]) >= 0 and (r := self.ranks.get((part[k], part[i]))) is not None:
                heapq.heappush(heap, (r, k, part[k], part[i]))
        return [x for x in part if x]

    def propose(self, word: str) -> list[int]:
        """Longest matches from the left."""
        i, n, out = 0, len(word), []
        while i < n:
            if n - i <= self.longest and (t := self.vocab.get(word[i:] + END)) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + self.longest), i, -1):
                if (t := self.vocab.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
            else:
                return []
        return out

    def _known(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens (left * 2**20 + right) is the encoding of its concatenation."""
        fresh = np.setdiff1d(pairs, self.pairs, assume_unique=False)
        if len(fresh):
            if len(self.pairs) > 2_000_000:
                self.pairs, self.holds = np.zeros(0, np.int64), np.zeros(0, bool)
                fresh = np.unique(pairs)
            answers = []
            for p in fresh.tolist():
                a, b = self.names[p >> 20], self.names[p & 0xFFFFF]
                answers.append(self.merge(self.symbols(a + b.removesuffix(END)) if b.endswith(END) else list(a + b)) == [a, b])
            order = np.argsort(both := np.concatenate([self.pairs, fresh]), kind="stable")
            self.pairs, self.holds = both[order], np.concatenate([self.holds, np.array(answers, bool)])[order]
        return self.holds[np.searchsorted(self.pairs, pairs)]

    def learn(self, words: list[str]):
        """Encode words not met before, all together."""
        spelled = ["".join(map(self.letters.__getitem__, w.encode())) for w in words]
        proposals = [self.propose(s) for s in spelled]
        lengths = np.array([len(p) for p in proposals])
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        good = lengths > 0
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            held = self._known((flat[:-1][inside] << 20) + flat[1:][inside])
            good &= np.bincount(owner[1:][inside], ~held, len(words)) == 0
        for w, s, p, ok in zip(words, spelled, proposals, good.tolist(), strict=True):
            if not ok:
                self.merged_words += 1
                p = [self.vocab[t] for t in self.merge(self.symbols(s))]
            self.counts[w], self.ids[w], self.texts[w] = len(p), " ".join(map(str, p)), " ".join(map(self.names.__getitem__, p))

    def words(self, text: str) -> list[str]:
        if not _PLAIN.search(text):
            return self.word.findall(text.lower())
        letters = {x: b for b, x in enumerate(self.letters)}
        cut = self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [bytes(map(letters.__getitem__, w)).decode() for w, _ in cut]

    def encode_all(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids joined by spaces, and decoded text of each text."""
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif "<|" in text and self.added_cut.search(text):
                cut.append([w for i, x in enumerate(self.added_cut.split(text)) for w in ([x] if i % 2 else self.words(x))])
            else:
                cut.append(self.words(text))
        if len(self.ids) > CACHED_WORDS:
            self.clear()
        for t, i in self.added.items():
            self.counts[t], self.ids[t], self.texts[t] = 1, str(i), t
        fresh = set().union(*cut).difference(self.ids)
        if fresh:
            self.learn(list(fresh))
        count, ids, said = self.counts.__getitem__, self.ids.__getitem__, self.texts.__getitem__
        return [(sum(map(count, w)), " ".join(map(ids, w)), " ".join(map(said, w))) for w in cut]


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, kept for the life of the worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", digest: bool = False) -> DataFrame:
    """Token ids and their decoded text, a row per document.

    digest=False: n_tokens, ids (joined by one space), decoded. digest=True: SHA-256 of the latter two instead.
    A null text counts as empty: no tokens. Other columns don't matter. Documents stay where they are; nothing is shuffled.
    """

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = bpe.encode_all(part.column("text").to_pylist())
                out = [[r[k] for r in rows] for k in range(3)]
                if digest:
                    out[1:] = [[hashlib.sha256(x.encode()).hexdigest() for x in c] for c in out[1:]]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names)

    names = [id_column, "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
    chosen = docs.select(docs[id_column].cast("bigint").alias("id"), docs[text_column].cast("string").alias("text"))
    return chosen.mapInArrow(run, f"`{id_column}` bigint, n_tokens bigint, {names[2]} string, {names[3]} string")


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id") -> DataFrame:
    """The text of each row of token ids (joined by one space): token strings joined by a space, as the vocabulary has no decoder."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            said = [" ".join(bpe.names[int(i)] for i in (x or "").split()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(said, pa.string())], [id_column, "decoded"])

    chosen = encoded.select(encoded[id_column].cast("bigint").alias("id"), "ids")
    return chosen.mapInArrow(run, f"`{id_column}` bigint, decoded string")

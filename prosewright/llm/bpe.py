"""BPE encoding and decoding: speculate, verify, and merge only what fails.

A byte-level BPE never merges across its pre-tokenizer's words, so each distinct word is encoded once and remembered.
Words not yet known are encoded together: a trie walk over all their bytes at once gives the longest token at every
position, and following those from each word's start proposes its tokens.  A proposal is the encoding exactly if every token of it
is what its own bytes encode to and every two adjacent tokens are compatible, that is, no merge across their border comes
before one of the merges that made them.  All adjacent pairs are tested together, undoing the later of a pair's two merges
step by step.  Words with an incompatible pair undergo exact merging.

Null text is the empty text: no ids.  Strings of added tokens inside a text become their ids, as the library does by default.
Repeated rows are encoded each; an empty table gives an empty result; columns not named in ``keep`` are ignored.  A text is
cut at safe boundaries, so besides the row itself memory is bounded; a single word without any boundary is held whole.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from prosewright.llm.packing import _SPELLED
from prosewright.llm.tokens import safe_pieces, tokenizer_path

GROUP_CHARS = 1 << 20  # of texts whose unknown words are encoded together
MEMO_CHARS = 1 << 25  # of words that are remembered, with their overhead
BATCH_BYTES = 1 << 23  # of what is handed back to Spark at once
NEVER = np.iinfo("i8").max

#: Fixed value: the words of the usual byte-level pre-tokenizer.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranges in which all Unicode versions since 13 agree on letters, digits and white space; a text with other characters is
#: cut into words by the library's own pre-tokenizer.
AGREED = "\x00-ԧא-תऀ-ॣ‐-⁤₠-₿←-⏿ぁ-ゖ゙-ヿ一-鿯가-힣！-～\U0001f300-\U0001f6d5"


class Merges:
    """A byte-level BPE's tables: tokens as bytes, what each is merged from, ranks of pairs, and the trie of sound tokens."""

    def __init__(self, vocab: dict[str, int], merges: list):
        byte_of = {chr(c): b for b, c in _SPELLED.items()} | {chr(b): b for b in range(256) if b not in _SPELLED}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        made = [vocab[a + b] for a, b in pairs]
        if len(set(made)) != len(made) or any(c not in vocab for c in byte_of):
            raise ValueError("needs a byte-level BPE with all single bytes and one merge for each other token")
        self.size = max(vocab.values()) + 1
        self.base = np.empty(256, "i8")
        for spelled, b in byte_of.items():
            self.base[b] = vocab[spelled]
        self.bytes: list[bytes] = [b""] * self.size
        for spelled, i in vocab.items():
            if all(c in byte_of for c in spelled):
                self.bytes[i] = bytes(byte_of[c] for c in spelled)
        self.left, self.right, self.rank = (np.full(self.size, -1, "i8") for _ in range(3))
        self.left[made], self.right[made] = [vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs]
        self.rank[made] = np.arange(len(made))
        key = self.left[made] * self.size + self.right[made]
        order = np.argsort(key)
        self.pair_key, self.pair_rank = np.append(key[order], NEVER), np.append(order, NEVER)
        self.made = np.array(made, "i8")
        self.rank_of = {(int(self.left[t]), int(self.right[t])): (k, t) for k, t in enumerate(made)}
        self._trie(self.sound())

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NEVER for pairs without one."""
        key = a * self.size + b
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of a and b comes first; ``before``: only merges of smaller rank count."""
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        x, y, limit = a.copy(), b.copy(), np.full(len(a), NEVER) if before is None else before.copy()
        while len(at):
            crosses = self.ranks(x, y) < limit
            ok[at[crosses]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crosses & (np.maximum(rx, ry) >= 0)
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            # undo what was merged last; of equal merges the left one comes first, so one of equal rank still crosses before the right one
            undo_x = rx > ry
            limit = np.where(undo_x, rx, ry + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def sound(self) -> np.ndarray:
        """Tokens that their own bytes encode to: no other merge comes before the one that makes them."""
        alone = self.compatible(self.left[self.made], self.right[self.made], np.arange(len(self.made)))
        out = np.zeros(self.size, bool)
        out[self.base] = True
        for t, own in sorted(zip(self.made.tolist(), alone.tolist(), strict=True), key=lambda x: self.rank[x[0]]):
            out[t] = own and out[self.left[t]] and out[self.right[t]]
        return out

    def _trie(self, sound: np.ndarray) -> None:
        edges: dict[int, int] = {}
        token = [-1]
        for t in np.flatnonzero(sound).tolist():
            node = 0
            for b in self.bytes[t]:
                node = edges.setdefault(node << 8 | b, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = t
        self.edge_key = np.array(sorted(edges), "i8")
        self.edge_to = np.array([edges[k] for k in self.edge_key.tolist()], "i8")
        self.edge_key, self.edge_to = np.append(self.edge_key, NEVER), np.append(self.edge_to, -1)
        self.token_at = np.array(token, "i8")

    def longest(self, flat: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that starts at each byte and does not go past ``end`` there: tokens and lengths."""
        token, length = self.base[flat], np.ones(len(flat), "i8")
        at, node, depth = np.arange(len(flat)), np.zeros(len(flat), "i8"), 0
        while len(at):
            key = node << 8 | flat[at + depth]
            to = np.searchsorted(self.edge_key, key)
            found = self.edge_key[to] == key
            at, node, depth = at[found], self.edge_to[to[found]], depth + 1
            here = self.token_at[node]
            token[at[here >= 0]], length[at[here >= 0]] = here[here >= 0], depth
            more = at + depth < end[at]
            at, node = at[more], node[more]
        return token, length

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all words in a row, and the index of each token's word."""
        size = np.array([len(w) for w in words])
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(words), "u1").astype("i8")
        token, length = self.longest(flat, np.repeat(start + size, size))
        visited = np.zeros(len(flat) + 1, bool)
        visited[start] = True
        jump, count = np.append(np.arange(len(flat)) + length, len(flat)), 0
        while (now := int(visited.sum())) > count:  # each step doubles how far the starts have been followed
            visited[jump[np.flatnonzero(visited)]] = True
            jump, count = jump[jump], now
        at = np.flatnonzero(visited[:-1])
        return token[at], np.searchsorted(start, at, side="right") - 1

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of smallest rank, the leftmost of equal ones."""
        ids = self.base[np.frombuffer(word, "u1")].tolist()
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        queue = [(found[0], i, found[1], a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (found := self.rank_of.get((a, b)))]
        heapq.heapify(queue)
        while queue:
            _, i, made, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(ids) and (found := self.rank_of.get((ids[p], ids[q]))):
                    heapq.heappush(queue, (found[0], p, found[1], ids[p], ids[q]))
        return [t for t in ids if t >= 0]

    def encode(self, words: list[bytes]) -> tuple[list[bytes], int]:
        """Each word's ids as little-endian 32-bit numbers, and how many words had to be merged exactly; no word is empty."""
        if not words:
            return [], 0
        token, word = self.propose(words)
        inside = word[1:] == word[:-1]
        wrong = np.flatnonzero(inside)[~self.compatible(token[:-1][inside], token[1:][inside])]
        failing = np.unique(word[wrong])
        packed = token.astype("<u4").tobytes()
        edge = (4 * np.searchsorted(word, np.arange(len(words) + 1))).tolist()
        out = [packed[a:b] for a, b in zip(edge, edge[1:], strict=False)]
        for i in failing.tolist():
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes()
        return out, len(failing)


class Codec:
    """Encodes and decodes whole texts; one for each worker and tokenizer file."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path(name))
        made = json.loads(self.tok.to_str())
        model, kind = made["model"], made["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or made["normalizer"] or kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind["add_prefix_space"]:
            raise ValueError(f"{name} is no plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
            raise ValueError(f"{name} has added tokens that take in what is beside them")
        self.merges = Merges(model["vocab"], model["merges"])
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.token_bytes = dict(enumerate(self.merges.bytes)) | {i: content.encode() for content, i in self.added.items()}
        self.is_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.word, self.odd = regex.compile(WORD), regex.compile(f"[^{AGREED}]")
        self.asked = self.merged = 0
        self._forget()

    def _forget(self) -> None:
        self.known = {content: i.to_bytes(4, "little") for content, i in self.added.items()}
        self.held = 0

    def words(self, text: str) -> Iterator[list[str]]:
        """A text's words in order, in lists of those of bounded parts."""
        for k, part in enumerate(self.is_added.split(text) if self.is_added else [text]):
            if k % 2:
                yield [part]
                continue
            for piece in safe_pieces(part, GROUP_CHARS):
                yield [piece[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(piece)] if self.odd.search(piece) else self.word.findall(piece)

    def _settle(self, group: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if self.held > MEMO_CHARS:
            self._forget()
        unknown = list({w for _, words in group for w in words}.difference(self.known))
        ids, failing = self.merges.encode([w.encode() for w in unknown])
        self.known.update(zip(unknown, ids, strict=True))
        self.held += sum(map(len, unknown)) + 64 * len(unknown)
        self.asked, self.merged = self.asked + len(unknown), self.merged + failing
        for i, words in group:
            out[i].append(b"".join(map(self.known.__getitem__, words)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        group, chars = [], 0
        for i, text in enumerate(texts):
            for words in self.words(text) if text else ():
                group.append((i, words))
                chars += sum(map(len, words))
                if chars >= GROUP_CHARS:
                    self._settle(group, out)
                    group, chars = [], 0
        self._settle(group, out)
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; unknown ids give nothing, bytes that are no UTF-8 the replacement character."""
        numbers = np.frombuffer(ids, "<u4")
        parts = (numbers[i : i + GROUP_CHARS].tolist() for i in range(0, len(numbers), GROUP_CHARS))
        return b"".join(b"".join(self.token_bytes.get(i, b"") for i in part) for part in parts).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    if name not in _CODECS:
        _CODECS[name] = Codec(name)
    return _CODECS[name]


def _groups(values: Iterable, size) -> Iterator[tuple[int, list]]:
    """(first row, values) of groups of about BATCH_BYTES, each small enough to be handed on at once."""
    first, group, held = 0, [], 0
    for value in values:
        group.append(value)
        held += size(value)
        if held >= BATCH_BYTES:
            yield first, group
            first, group, held = first + len(group), [], 0
    if group:
        yield first, group


def encode_texts(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep`` columns, n_tokens, ids (little-endian 32-bit numbers) and, if asked for, the text decoded from them; one scan."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decoded

    def encoded(batches):
        import pyarrow as pa

        own = codec(tokenizer)
        for batch in batches:
            values = (v.as_py() for v in batch.column(len(keep)))
            for first, texts in _groups(values, lambda v: len(v or "")):
                ids = own.encode(texts)
                made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    made.append(pa.array([own.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[: len(keep)]), *made], names=[*keep, *(f.name for f in fields)])

    return docs.select(*keep, docs[text].cast("string").alias("text")).mapInArrow(encoded, T.StructType([docs.schema[c] for c in keep] + fields))


def decode_ids(frame: DataFrame, tokenizer: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the text of packed ids; null ids give the empty text."""

    def decoded(batches):
        import pyarrow as pa

        own = codec(tokenizer)
        for batch in batches:
            for first, values in _groups((v.as_py() or b"" for v in batch.column(len(keep))), len):
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(values)) for c in batch.columns[: len(keep)]), pa.array([own.decode(v) for v in values], pa.string())], names=[*keep, "text"])

    schema = T.StructType([frame.schema[c] for c in keep] + [T.StructField("text", T.StringType())])
    return frame.select(*keep, frame[ids].cast("binary").alias("ids")).mapInArrow(decoded, schema)

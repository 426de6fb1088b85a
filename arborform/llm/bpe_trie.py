"""Operator 12: BPE encoding by a depth-first walk of a trie of words, and decoding.

BPE merges inside the words that the tokenizer's own normaliser and splitter
make, so a task encodes each of its distinct words once. The words of a block,
sorted, are the leaves of their trie in depth-first order: the walk keeps the
path from the root (a stack) and never the whole trie, steps back to what two
neighbours share, and visits every node of the trie once.

State of a node: the last token of the encoding of its prefix. It is the one
vocabulary token t that ends there, encodes to itself, and whose neighbour, the
state where t begins, is not merged with it: the pair's own symbols, merged by
rank, give the two tokens back (remembered per pair). So states follow from
states further up the path, shared prefixes are encoded once, and a word's
tokens are read off from its end backwards. A suffix that marks a word's end
belongs to the last symbol only; that step is a leaf edge of its own.

Texts. ASCII white space separates what the tokenizer treats apart, so texts are
cut there and the cut pieces are remembered too (up to a number of characters;
then the memory starts anew). Strings of special tokens inside a text become
those tokens, as in the library's own call without ``encode_special_tokens``.
All of it runs in one pass over the rows, without a shuffle; a lost task is
repeated alone.

Defined results: a null text counts as empty: no ids, empty decoded text; an
empty table gives an empty table; keys may be null or repeated, every row gets
its own result; a text is encoded whole at any length (time linear in it);
columns other than key and text are not read, whatever their names.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import blocks, column, ship_by_value, worker_state

BLOCK = 2_000_000           # characters worked on at once
HELD = 3_000_000            # characters of pieces that a worker remembers
PAIRS = 500_000             # pairs of tokens that a worker remembers
CALL = 200                  # pieces in one call of the tokenizer's normaliser and splitter
# white space outside ASCII, and what other libraries take for it
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]")


class Merges:
    """A BPE vocabulary with its merges, and which tokens stand side by side."""

    def __init__(self, model: dict):
        if model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain BPE models, with or without an end-of-word suffix")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.parts = {a + b: (a, b) for a, b in pairs}
        made = {a + b: i for i, (a, b) in enumerate(pairs)}
        if len(made) < len(pairs) or any(made.get(x, -1) >= i for i, p in enumerate(pairs) for x in p):
            raise ValueError("a token with two merges, or merged before its parts")
        self.made, self.first, self.last = made, {}, {}
        # tokens whose own symbols merge to them; no other can be in an encoding
        self.width, self.reached = {}, {}      # a token stands for itself: no copy of its text is held
        for t in sorted(self.ids, key=lambda t: made.get(t, -1)):
            a, b = self.parts.get(t, (None, None))
            self.width[t] = self.width[a] + self.width[b] if a is not None else 1
            if a is None or a in self.reached and b in self.reached and self.stand(a, b, made[t]):
                self.reached[t] = t
        self.first, self.last = {}, {}          # from here on only of tokens that are asked for
        self.packed = {t: struct.pack("<I", i) for t, i in self.ids.items()}
        self.beside = {}                        # what stand() said of a pair, for a while
        self.reach = {}                         # last three symbols -> width of the widest token with them
        for t in self.reached:
            if self.width[t] > 2:
                end = t[-3 - len(self.suffix):] if self.suffix and t.endswith(self.suffix) else t[-3:]
                self.reach[end] = max(self.reach.get(end, 3), self.width[t])

    def spine(self, whole: str, side: int) -> list[tuple[str, float]]:
        """What stands at one end of the token while it is merged together, from
        the symbol on, each with the rank of the merge that takes it up."""
        out, until, token = [], float("inf"), whole
        while True:
            out.append((token, until))
            if token not in self.parts:
                break
            until, token = self.made[token], self.parts[token][side]
        (self.last if side else self.first)[whole] = out = out[::-1]
        return out

    def stand(self, left: str, right: str, below: float = float("inf")) -> bool:
        """Whether no merge (of a rank under ``below``) crosses from one token into
        the other. Merges go by rank, so each end's stages follow one another in
        time, and only stages of the same time can meet; of equal ranks the
        leftmost goes first."""
        xs, ys, i, j = self.last.get(left) or self.spine(left, 1), self.first.get(right) or self.spine(right, 0), 0, 0
        while True:
            (x, until_x), (y, until_y) = xs[i], ys[j]
            q = self.rank.get((x, y))
            if q is not None and q < until_x and q <= until_y and q < below:
                return False
            if until_x <= until_y:
                i += 1
                if i == len(xs):
                    return True
            else:
                j += 1


def walk(words: list[str], merges: Merges) -> dict[str, bytes]:
    """Packed ids of each of the distinct words: the depth-first walk of their trie."""
    reached, stand, width, reach = merges.reached, merges.stand, merges.width, merges.reach
    packed, beside, tail = merges.packed, merges.beside, merges.suffix
    if len(beside) > PAIRS:
        beside.clear()
    state, path, out = [""], "", {}             # state[d]: last token of path[:d]
    for word in sorted(words):
        inner = word[:-1] if tail else word     # the last symbol is another one
        same = 0
        for a, b in zip(path, inner):
            if a != b:
                break
            same += 1
        del state[same + 1:]
        for end in range(same + 1, len(word) + 1):
            if end > len(inner):                # the leaf edge
                text = word + tail
                stop = len(text)
            else:
                text, stop = word, end
            # no token that ends in these three symbols is wider than ``far``
            far = reach.get(text[end - 3:stop], 2) if end > 2 else end
            for s in range(end - far if end > far else 0, end):
                token = reached.get(text[s:stop])
                if token is not None:
                    if s == 0:
                        break
                    left = state[s]
                    apart = beside.get((left, token))
                    if apart is None:
                        apart = beside[left, token] = left is not None and stand(left, token)
                    if apart:
                        break
            else:
                token = None                    # a character that the vocabulary lacks
            state.append(token)
        back, d = [], len(word)
        while d > 0:
            token = state[d]
            if token is None:
                raise ValueError(f"no token of the vocabulary fits {word[:40]!r}")
            back.append(packed[token])
            d -= width[token]
        out[word] = b"".join(back[::-1])
        path = inner
    return out


class Encoder:
    """Texts to ids, equal to the tokenizer's own call on each whole text."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer
        conf = json.loads(source)
        t = Tokenizer.from_str(source)
        if conf["model"]["type"] != "BPE" or conf.get("post_processor") is not None and conf["post_processor"]["type"] != "ByteLevel":
            raise ValueError("only BPE tokenizers without a template")
        added = conf.get("added_tokens") or []
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] or re.search(r"\s", a["content"]) for a in added):
            raise ValueError("only added tokens that match as they stand")
        self.added = {a["content"]: a["id"] for a in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.special = {i: struct.pack("<I", i) for i in self.added.values()}
        self.normalise = t.normalizer.normalize_str if t.normalizer else lambda s: s
        self.words = t.pre_tokenizer.pre_tokenize_str if t.pre_tokenizer else lambda s: [(s, None)]
        # white space may be cut away before only if the tokenizer itself drops it
        self.pieces = not self.words(self.normalise(" \t\n\r\x0b\x0c"))
        self.merges = Merges(conf["model"])
        self.known, self.size = {}, 0

    def split(self, piece: str) -> list:
        """Words (text) and special tokens (id) of a piece, in order."""
        parts = self.cut.split(piece) if self.cut else [piece]
        out = []
        for p in parts:
            if self.cut and p in self.added:
                out.append(self.added[p])
            elif p:
                out += [w for w, _ in self.words(self.normalise(p)) if w]
        return out

    def split_many(self, pieces: list[str]) -> list[list]:
        """``split`` of each piece. Pieces without white space or special tokens
        go through the tokenizer's parts many at a time, set apart by line ends."""
        out = [None] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if not OTHER_SPACE.search(p) and not (self.cut and self.cut.search(p))] if self.pieces else []
        for n in range(0, len(plain), CALL):
            part = plain[n:n + CALL]
            text = self.normalise("\n".join([pieces[i] for i in part]))
            forms = text.split()
            if len(forms) != len(part) or sum(map(len, forms)) + len(forms) - 1 != len(text):
                continue                        # not what was put together: one by one below
            for i in part:
                out[i] = []
            at, end = 0, len(forms[0])
            for w, (a, _) in self.words(text):
                while a >= end:
                    at += 1
                    end += 1 + len(forms[at])
                out[part[at]].append(w)
        return [self.split(p) if o is None else o for p, o in zip(pieces, out)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        cut = [r.split() if self.pieces else [r] for r in raw]      # bytes: ASCII white space only
        new = set().union(*cut) - self.known.keys()
        if self.size + sum(map(len, new)) > HELD:
            self.known, self.size, new = {}, 0, set().union(*cut)
        new = list(new)
        parts = self.split_many([p.decode("utf-8", "surrogatepass") for p in new])
        ids = walk(list(set().union(*parts) - self.special.keys()), self.merges) | self.special
        known = self.known
        known.update((p, ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])) for p, ws in zip(new, parts))
        self.size += sum(map(len, new))
        return [b"".join([known[p] for p in c]) for c in cut]


class Decoder:
    """Ids to text, special tokens kept."""

    def __init__(self, source: str):
        conf = json.loads(source)
        names = {i: t for t, i in conf["model"]["vocab"].items()} | {a["id"]: a["content"] for a in conf.get("added_tokens") or []}
        self.names, self.join = [names.get(i) for i in range(max(names, default=-1) + 1)], " ".join
        if conf.get("decoder"):
            from tokenizers import Tokenizer
            self.join = Tokenizer.from_str(source).decoder.decode

    def decode(self, ids: bytes) -> str:
        names = self.names
        return self.join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(df: DataFrame, key: str, text: str, tokenizer_path: str, decoded: bool = False) -> DataFrame:
    """key, n_tokens, ids (packed: little-endian unsigned 32-bit integers) of each
    row and, if asked for, ``decoded``: the text of these ids."""
    ship_by_value()
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()                       # the driver's file, shipped to the tasks
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches):
        e = worker_state(f"trie {zlib.crc32(source.encode())}", lambda: Encoder(source))
        d = worker_state(f"names {zlib.crc32(source.encode())}", lambda: Decoder(source)) if decoded else None
        for batch in batches:
            texts, keys = column(batch, "text"), batch.column(batch.schema.get_field_index("key"))
            for lo, hi in blocks(texts, BLOCK):
                gc.disable()                    # its scans of the pieces held would cost a third of the time
                ids = e.encode(texts[lo:hi])
                gc.enable()
                out = [keys.slice(lo, hi - lo), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    out.append(pa.array([d.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["key", "n_tokens", "ids", "decoded"][:len(out)])
    return rows.mapInArrow(run, f"key {kind}, n_tokens bigint, ids binary" + ", decoded string" * decoded).withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, tokenizer_path: str, keep: tuple = ()) -> DataFrame:
    """key, the ``keep`` columns, ids and ``decoded`` (their text) of each row."""
    ship_by_value()
    with open(tokenizer_path, encoding="utf-8") as f:
        source = f.read()
    rows = df.select(F.col(key).alias("key"), *keep, F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        d = worker_state(f"names {zlib.crc32(source.encode())}", lambda: Decoder(source))
        for batch in batches:
            packed = column(batch, "ids")
            for lo, hi in blocks(packed, 4 * BLOCK):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([d.decode(i) for i in packed[lo:hi]], pa.string())],
                                                 names=[*part.schema.names, "decoded"])
    return rows.mapInArrow(run, kinds + ", decoded string").withColumnRenamed("key", key)

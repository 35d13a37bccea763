"""SentencePiece merge-type (BPE) encoding and decoding.

Encoding is exact and needs no priority queue. A token sequence is the result of
the merges if and only if every two neighbours, put together and merged again,
come out as the same two tokens. So the encoder takes the longest Aho-Corasick
match at each position, checks it against the token before by re-merging the two,
falls back to shorter matches, and steps back when none fits; a bitfield keeps
the positions from which no encoding was found, so that none is tried twice and
the work stays linear in the text.

Work is split at word starts (white space is part of the next word) when no piece
of the vocabulary can cross one; otherwise the whole text is one unit.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import itertools
import re
import string
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame

from .common import give_back

SPACE = "▁"
_HIGH_BYTES = re.compile("[\udc80-\udcff]+")  # stand for bytes in joined surfaces; no piece can hold them
_CACHE_UNITS, _CACHE_PAIRS, _CACHED_LENGTH = 700_000, 400_000, 48


def _unit_pattern(pieces: Iterable[str]) -> str:
    """A pattern that cuts texts where no merge can reach across.

    A merge across two neighbouring characters makes a piece that holds them side by
    side. So a text may be cut before white space if no piece goes on after other
    characters with it, around marks that no piece puts beside anything but marks (and
    white space before them), and around ASCII characters that no piece holds.
    """
    pieces = list(pieces)
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return "(?s).+"
    marks, left = set(string.punctuation), 0
    while left != len(marks):
        left = len(marks)
        for p in pieces:
            for x, y in itertools.pairwise(p):
                if x != SPACE and (x in marks) != (y in marks):
                    marks -= {x, y}
    held = set().union(*pieces)
    alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in held and chr(c) not in marks and c != 32)
    own = re.escape("".join(sorted(marks)))
    parts = [f"{SPACE}*[^{SPACE}{own}{alone}]+", f"{SPACE}+"]
    parts += [f"{SPACE}*[{own}]+"] if own else []
    parts += [f"[{alone}]"] if alone else []
    return "|".join([parts[0], *parts[2:], parts[1]])


class PieceCodec:
    """Encoder and decoder for one model file with identity normalisation.

    The library is used only to read the vocabulary; it takes no part in encoding
    or decoding. Models that rewrite their input (NFKC and the like) are refused.
    """

    def __init__(self, model_path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        sample = "a  １ﬁ b "
        if lib.normalize(sample) != SPACE + sample.replace(" ", SPACE):
            raise ValueError("only models with identity normalisation and a space put before the text are supported")
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.byte_of: dict[int, int] = {}
        self.surface: list[str] = []
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_control(i):
                self.surface.append("")
            elif lib.is_unknown(i):
                self.surface.append(" ⁇ ")
            elif lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
                b = self.byte_of[i]
                self.surface.append(chr(b) if b < 128 else chr(0xDC00 + b))
            else:
                self.ids[piece] = i
                self.scores[piece] = lib.get_score(i)
                self.surface.append(piece.replace(SPACE, " "))
        self.unk_id, self.eos_id = lib.unk_id(), lib.eos_id()
        self.matcher = ahocorasick.Automaton()
        for piece in self.ids:
            self.matcher.add_word(piece, len(piece))
        self.matcher.make_automaton()
        self._most = max(map(len, self.ids))
        # The next shorter piece that starts a piece; at the end its first character, be it a piece or not.
        self._shorter: dict[str, str] = {}
        for piece in self.ids:
            if len(piece) > 1:
                self._shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.ids), piece[0])
        self._bigrams = {a + b for p in self.ids for a, b in itertools.pairwise(p)}
        self._units = re.compile(_unit_pattern(self.ids))
        self._pairs: dict[tuple[str, str], bool] = {}
        self._cache: dict[str, tuple[list[int], str]] = {}
        self._old: dict[str, tuple[list[int], str]] = {}
        self._numbers = [str(i) for i in range(len(self.surface))]

    def remerge(self, text: str) -> list[str]:
        """The merges done literally: best score first, leftmost among equals."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether two tokens may stand side by side; ``left`` is empty at the start."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= _CACHE_PAIRS:
                self._pairs.clear()
            known = self.remerge(left + right) == ([left, right] if left else [right])
            self._pairs[left, right] = known
        return known

    def _tokens(self, unit: str) -> list[str]:
        ids, shorter, pairs, match, most = self.ids, self._shorter, self._pairs, self.matcher.longest_prefix, self._most
        n, failed = len(unit), None
        out: list[str] = []
        pos, prev, token = 0, "", None
        while True:
            if token is None:  # the longest piece that starts here; a character that starts none stands for itself
                ahead = unit[pos : pos + most]
                token = ahead[: match(ahead) or 1]
                while token not in ids and len(token) > 1:  # the automaton's path may go past its last piece
                    token = token[:-1]
            while token:
                end = pos + len(token)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get((prev, token))
                    if fits is None:
                        fits = self.compatible(prev, token)
                    if fits:
                        break
                token = shorter.get(token, "")
            if token:
                out.append(token)
                if end == n:
                    return out
                pos, prev, token = end, token, None
            else:
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                token = out.pop()
                pos -= len(token)
                prev = out[-1] if out else ""
                token = shorter.get(token, "")

    def _unit(self, unit: str) -> tuple[list[int], str]:
        found = self._old.get(unit)
        if found is not None:
            if len(self._cache) < _CACHE_UNITS:
                self._cache[unit] = found
            return found
        if 1 < len(unit) <= _CACHED_LENGTH and unit[-2:] not in self._bigrams:  # no merge reaches the last character
            out, joined = self._cache.get(unit[:-1]) or self._unit(unit[:-1])
            last, number = self._cache.get(unit[-1]) or self._unit(unit[-1])
            found = (out + last, f"{joined} {number}")
        else:
            tokens = self._tokens(unit)
            try:
                out = [self.ids[t] for t in tokens]
            except KeyError:
                out = self._with_bytes(tokens)
            found = (out, " ".join([self._numbers[i] for i in out]))
        if len(unit) <= _CACHED_LENGTH:
            if len(self._cache) >= _CACHE_UNITS:  # the generation before stays: frequent units are never all lost
                self._old, self._cache = self._cache, {}
            self._cache[unit] = found
        return found

    def _with_bytes(self, tokens: list[str]) -> list[int]:
        """Characters that are no piece become their UTF-8 bytes, or the unknown id."""
        out: list[int] = []
        for token in tokens:
            i = self.ids.get(token)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in token.encode("utf-8", "replace")]
            else:
                out.append(self.unk_id)
        return out

    def _encoded_units(self, text: str) -> list[tuple[list[int], str]]:
        if not text:
            return []
        known = self._cache.get
        return [known(u) or self._unit(u) for u in self._units.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str | None, add_eos: bool = False) -> list[int]:
        out = list(chain.from_iterable([ids for ids, _ in self._encoded_units(text or "")]))
        return out + [self.eos_id] if add_eos else out

    def encode_joined(self, text: str | None, add_eos: bool = False) -> tuple[list[int], str]:
        """The ids, and the same in decimal, joined by one space."""
        units = self._encoded_units(text or "")
        lists, words = zip(*units, strict=True) if units else ((), ())
        ids, words = list(chain.from_iterable(lists)), list(words)
        if add_eos:
            ids.append(self.eos_id)
            words.append(self._numbers[self.eos_id])
        return ids, " ".join(words)

    def decode(self, ids: Iterable[int]) -> str:
        """Pieces put together; the space put before the text goes; runs of byte ids
        become characters, bytes that form none U+FFFD each."""
        ids = list(ids)
        text = "".join(map(self.surface.__getitem__, ids))
        try:
            text.encode()
        except UnicodeEncodeError:
            # Bytes on both sides of an invisible control id are no run.
            text = "".join([self.surface[i] or "\udc00" for i in ids])
            text = _HIGH_BYTES.sub(lambda run: _lenient(bytes(ord(c) - 0xDC00 for c in run[0])), text).replace("\udc00", "")
        return text[1:] if text[:1] == " " and self._starts_with_piece(ids) else text

    def _starts_with_piece(self, ids: list[int]) -> bool:
        first = next((i for i in ids if self.surface[i]), self.unk_id)
        return first != self.unk_id and first not in self.byte_of


def _lenient(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + n].decode())
                    at += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_CODECS: dict[str, PieceCodec] = {}


def codec(model_path: str) -> PieceCodec:
    """One codec for each model and process; ``release`` gives its memory back."""
    if model_path not in _CODECS:
        _CODECS[model_path] = PieceCodec(model_path)
    return _CODECS[model_path]


@contextlib.contextmanager
def _without_cycle_search() -> Iterator[None]:
    """The caches hold millions of lists and no cycles; searching them for cycles again and again costs a fifth of the time."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def release() -> None:
    _CODECS.clear()


def encode_column(df: DataFrame, model_path: str, text: str = "text", ids: str = "token_ids", add_eos: bool = True) -> DataFrame:
    """``df`` with the token ids of ``text`` as an array column ``ids``.

    A null text counts as empty. An existing column of the name ``ids`` is
    replaced. Rows are handled one by one: no shuffle, and any row count or
    length works.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import ArrayType, IntegerType

    @F.pandas_udf(ArrayType(IntegerType()))
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model_path)
        for part in parts:
            yield pd.Series([own.encode(t, add_eos) for t in part], dtype=object)

    return df.withColumn(ids, encode(F.coalesce(F.col(text), F.lit(""))))


def decode_column(df: DataFrame, model_path: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """``df`` with the decoded text of the id array ``ids``; a null array gives an empty text."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(model_path)
        for part in parts:
            yield pd.Series(["" if x is None else own.decode(int(i) for i in x) for x in part], dtype=object)

    return df.withColumn(text, decode(F.col(ids)))


def token_digests(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens (with the end id), and SHA-256 of the decimal ids and of the decoded text.

    Null texts count as empty (only the end id; empty decoded text). Repeated rows
    give repeated rows, an empty table an empty one; other columns are left unread.
    """

    def digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        for part in parts:
            counts, ids_sha, text_sha = [], [], []
            with _without_cycle_search():
                for t in part["own_text"]:
                    ids, joined = own.encode_joined(t, add_eos=True)
                    counts.append(len(ids))
                    ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids).encode("utf-8", "replace")).hexdigest())
            yield pd.DataFrame({"own_key": part["own_key"], "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    from pyspark.sql import functions as F

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("own_key"), F.coalesce(F.col(text), F.lit("")).alias("own_text"))
    out = rows.mapInPandas(digest, f"own_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("own_key", key)


def tokenized(df: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, token_ids (with the end id), and decoded_sha256 as in ``token_digests``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(model_path)
        for part in parts:
            for at in range(0, len(part), 1000):  # a bounded number of id lists at a time
                some = part.iloc[at : at + 1000]
                with _without_cycle_search():
                    ids = [own.encode(t, add_eos=True) for t in some["own_text"]]
                sha = [hashlib.sha256(own.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids]
                yield pd.DataFrame({"own_key": some["own_key"], "n_tokens": [len(x) for x in ids], "token_ids": pd.Series(ids, index=some.index, dtype=object), "decoded_sha256": sha})
        del own
        release()  # the worker goes on to other stages
        give_back()

    from pyspark.sql import functions as F

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("own_key"), F.coalesce(F.col(text), F.lit("")).alias("own_text"))
    return rows.mapInPandas(run, f"own_key {kind}, n_tokens long, token_ids array<int>, decoded_sha256 string").withColumnRenamed("own_key", key)

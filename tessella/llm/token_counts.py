"""Token counts: batch encoding in Arrow functions that returns lengths only."""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import ship, source_columns

#: A cut is safe at one of these: no token, merge or special string of the vocabularies in use spans ASCII white space followed by a non-blank.
_PIECE = re.compile(rb"[^\x20\x09-\x0D]+")


#: What a plain text may hold, but for "<|", the signs C3 97 and C3 B7, and C4 B0, whose small letter is two: ASCII without control characters, and Latin letters from U+00C0 to
#: U+027F. So there are no combining marks, and case and composition don't interact.
_PLAIN = bytes([9, 10, 11, 12, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
#: All bytes but punctuation other than commas and full stops.
_EASY = bytes(b for b in range(256) if chr(b) not in "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~")
#: A whole run of ASCII punctuation without an apostrophe, which contractions start with.
_RUN = re.compile(rb"(?<![!-/:-@\[-`{-~])([!-&(-/:-@\[-`{-~]++)(?!')")
#: Encodes to one id of its own between blanks, which is where a joined batch is cut again.
_CUT = "\x01"
JOINED = 50


def nones(values: list) -> Iterator[int]:
    """Where the Nones are; list.index skips the rest at C speed."""
    at = -1
    try:
        while True:
            at = values.index(None, at + 1)
            yield at
    except ValueError:
        return


class Memory:
    """A dictionary of at most `most` entries; when its young half is full, that becomes the old one. Entries in use move on to the young half."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def room(self) -> None:
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}

    def revived(self, keys: set) -> list:
        """Moves keys that only the old half has to the young one, and returns the others."""
        back = {k: self.old[k] for k in keys if k in self.old}
        self.young.update(back)
        return [k for k in keys if k not in back]


def byte_letters() -> dict[int, str]:
    """How byte-level tokenizers spell a byte: printable Latin-1 bytes as themselves, the others as the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of ASCII-blank separated words by a library tokenizer; a distinct word is encoded once while it stays in the memory.

    Right only for tokenizers that drop white space and end tokens there, which is tested. Where probes show that case is ignored and that
    punctuation is a token of its own, plain texts are lower-cased and cut there too: fewer distinct words. The memory is bounded and changes
    no result.
    """

    def __init__(self, path: str, most: int = 600_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not splits_at_blanks(self.tokenizer):
            raise ValueError(f"{path}: its tokens depend on white space; use whole-text encoding")
        cut = self._whole([_CUT])[0]
        self.cut = cut[0] if len(cut) == 1 else None
        self.parted = parts_letters(self.tokenizer)
        #: Whether the model alone, without normalising and cutting, encodes words of small letters as the whole tokenizer does.
        probes = ["hello", "a", "zebrahoods", "straße", "été", "ñandú", "œuvre", "qzxv"]
        self.spelling = byte_letters()
        self.direct = all(self._model(p.encode()) == struct.pack(f"<{len(e)}i", *e) for p, e in zip(probes, self._whole(probes), strict=True))
        #: A word's ids as little-endian 32-bit integers, and how many they are; a worker fills the one that it is asked for.
        self.ids, self.counts = Memory(most), Memory(most)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _model(self, word: bytes) -> bytes:
        spelt = word.decode() if word.isalpha() else word.decode("latin-1").translate(self.spelling)  # of bytes, isalpha means ASCII letters
        ids = [t.id for t in self.tokenizer.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}i", *ids)

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        if not self.direct:
            return self._by_tokenizer(words)
        easy = {w: self._model(w) for w in words if small_letters(w)}
        rest = [w for w in words if w not in easy]
        easy.update(zip(rest, self._by_tokenizer(rest), strict=True))
        return [easy[w] for w in words]

    def _by_tokenizer(self, words: list[bytes]) -> list[bytes]:
        if self.cut is None:
            return [struct.pack(f"<{len(e)}i", *e) for e in self._whole([w.decode() for w in words])]
        out: list[bytes] = []
        mark = _CUT.encode()
        marked = [w for w in words if mark in w]
        odd = {w: struct.pack(f"<{len(e)}i", *e) for w, e in zip(marked, self._whole([w.decode() for w in marked]), strict=True)}
        plain = [w for w in words if w not in odd]
        between = b" " + mark + b" "
        for i in range(0, len(plain), 5000):
            part = plain[i : i + 5000]
            flat = np.array([x for e in self._whole([(between.join(part[k : k + JOINED]) + between).decode() for k in range(0, len(part), JOINED)]) for x in e], "<i4")
            ends = np.flatnonzero(flat == self.cut) * 4
            assert len(ends) == len(part)
            raw, at = flat.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[at:end])
                at = end + 4
        done = iter(out)
        return [odd[w] if w in odd else next(done) for w in words]

    def _split(self, text: bytes) -> list[bytes]:
        if not self.parted or text.translate(None, _PLAIN) or any(x in text for x in (b"<|", b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")):
            return text.split()
        text = text.lower()
        if text.translate(None, _EASY) or any(x in text for x in (b"..", b",,", b".,", b",.")):
            return _RUN.sub(rb" \1 ", text).split()
        return text.replace(b",", b" , ").replace(b".", b" . ").split()

    def _looked_up(self, texts: list[bytes], memory: Memory, value: Callable[[bytes], object]) -> list[list]:
        """What the memory holds for each word of each text. New words of all the texts are encoded together, in batches."""
        memory.room()
        young = memory.young
        split = [self._split(t) for t in texts]
        found = [list(map(young.get, words)) for words in split]
        gaps = [list(nones(f)) for f in found]
        new = memory.revived({words[i] for words, g in zip(split, gaps, strict=True) for i in g})
        young.update(zip(new, map(value, self._encoded(new)), strict=True))
        for words, f, g in zip(split, found, gaps, strict=True):
            for i in g:
                f[i] = young[words[i]]
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        return [b"".join(f) for f in self._looked_up(texts, self.ids, bytes)]

    def lengths(self, texts: list[bytes]) -> list[int]:
        """How many ids each text has; no text's ids are put together."""
        return [sum(f) for f in self._looked_up(texts, self.counts, lambda ids: len(ids) // 4)]

    #: Whether a text's tokens are those of its parts between blanks.
    cuts = True


class WholeEncoder:
    """The same for vocabularies whose tokens may hold white space: whole texts in batches, by tokenizers (.json) or sentencepiece (.model)."""

    cuts = False

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: model.encode(texts, num_threads=1)
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.no_truncation()
            whole.no_padding()
            self._ids = lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(ids, "<i4").tobytes() for ids in self._ids([t.decode() for t in texts])]

    def lengths(self, texts: list[bytes]) -> list[int]:
        return [len(ids) for ids in self._ids([t.decode() for t in texts])]


def small_letters(word: bytes) -> bool:
    """Only small letters below U+0280: one piece for the tokenizer, and nothing to normalise."""
    if word.isascii():
        return word.isalpha() and word.islower()
    s = word.decode()
    return max(s) < "\u0280" and s.isalpha() and s.lower() == s


@functools.lru_cache(maxsize=1)
def text_encoder(path: str, most: int = 600_000) -> WordEncoder | WholeEncoder:
    """One for each Python worker, so that its memory of `most` words serves all tasks that the worker runs. Probes decide whether words can be encoded apart."""
    if path.endswith(".model"):
        return WholeEncoder(path)
    try:
        return WordEncoder(path, most)
    except ValueError:
        return WholeEncoder(path)


def parts_letters(tokenizer) -> bool:
    """Whether punctuation is encoded apart from its neighbours and A-Z counts as a-z, judged from probes."""
    one = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    probes = ["Hello.", "été!?Où", "Straße\",x", "a<b>", "ÉCOLE$$$", "x_-_Y", "3,5%", "(Ɛnd)", "it's,IT'S", "e.g.'", "a=='b'"]
    return all(one(p) == [i for w in _RUN.sub(rb" \1 ", p.encode().lower()).split() for i in one(w.decode())] for p in probes)


def splits_at_blanks(tokenizer) -> bool:
    """Whether white space is dropped and ends every token, judged from probes."""
    probes = ["the cat's 12 dogs!", "a\tb\nc\x0bd\x0ce\rf", " lead  and trail ", "x<|endoftext|> y <|startoftext|>", "été É ́x", "A B  c"]
    one = lambda s: tokenizer.encode(s, add_special_tokens=False).ids
    return all(one(p) == [i for w in p.encode().split() for i in one(w.decode())] for p in probes)


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """Text cut at safe boundaries into parts of about `most` bytes; a longer word stays whole."""
    at = 0
    while len(text) - at > most:
        found = _PIECE.search(text, at + most)
        cut = len(text)
        while found:
            if found.start() > at + most or text[found.start() - 1 : found.start()] in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"):
                cut = found.start()
                break
            found = _PIECE.search(text, found.end())
        yield text[at:cut]
        at = cut
    if at < len(text) or not at:
        yield text[at:]


def balanced(texts: Iterable[bytes], most: int, cuts: bool = True) -> Iterator[list[tuple[int, bytes]]]:
    """Pieces, or whole texts where these can't be cut, in batches of about `most` bytes, each with its text's place."""
    batch, held = [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text, most) if cuts else (text,):
            batch.append((i, piece))
            held += len(piece)
            if held >= most:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def counter(path: str, batch_bytes: int) -> Callable:
    """An Arrow function: (doc_id, text) to (doc_id, n_bytes, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or text_encoder(path)
            sizes, totals = [0] * batch.num_rows, [0] * batch.num_rows
            texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1))
            for part in balanced(texts, batch_bytes, encoder.cuts):
                for (i, piece), n in zip(part, encoder.lengths([p for _, p in part]), strict=True):
                    sizes[i] += len(piece)
                    totals[i] += n
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 2048, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    Texts longer than batch_bytes are cut where white space ends if the vocabulary drops white space, which changes no count; other
    vocabularies get whole texts. Null or empty text: 0 bytes, 0 tokens. Rows come back one for
    one, repeated and null ids included; columns besides doc_id and text are not read. No shuffle: one pass, memory bounded by a batch.
    """
    ship(docs.sparkSession)
    out = source_columns(docs, "doc_id", "text").mapInArrow(counter(path, batch_bytes), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

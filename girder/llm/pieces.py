"""SentencePiece encoding and decoding by vectorised merge rounds.

A BPE piece model joins, again and again, the adjacent pair of symbols whose
join is the best piece, the leftmost one among equals.  No piece crosses from a
visible character to a following space mark, so a text falls apart into words
that merge independently.  All distinct words of a slice are merged at once:

* the symbols lie in one flat array, with one rank for each adjacent pair;
* a segmented minimum finds the best rank of each word;
* every word merges its leftmost pairs of that rank at once -- all of them if no
  pair that such a merge makes would come before the rest, else the first alone;
* merged symbols are compacted, and finished words leave the arrays.

The rounds end when no pair is left.  The result is the library's own, id by id:
words are told apart by two independent 64-bit hashes, and where the first ones
of different words agree, none of them is taken for another.

Cases: null and empty texts give the begin and end ids alone and decode to an
empty text; characters without a piece give their UTF-8 bytes; a text of any
length is one unit; repeated rows give repeated rows; an empty table gives no
rows; other columns pass through and an output name that is taken gets a leading
underscore.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.llm.flat import SEQ_BASE, U64, mix, ragged, span_hashes
from girder.llm.shared import fresh, table

SPACE = "▁"
MARK = ord(SPACE)
NONE = np.int32(2**31 - 1)
SLICE_CHARS = 1 << 20
CACHE_WORDS = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTables:
    """Arrays made from a BPE model: pair ranks, the bytes of pieces, and which characters can merge."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        self.bos, self.eos, self.unk, self.size = sp.bos_id(), sp.eos_id(), sp.unk_id(), size
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        normal = {name: i for i, name in enumerate(names) if not special[i]}
        if any(SPACE in name.lstrip(SPACE) for name in normal):
            raise ValueError("this model has pieces over several words")
        scores = np.array([sp.get_score(i) for i in range(size)])
        rank_of = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        chars = {c for name in normal for c in name}
        extra = {c: size + k for k, c in enumerate(sorted(c for c in chars if c not in normal))}
        symbol = normal | extra
        pairs = []
        for name, i in normal.items():
            for cut in range(1, len(name)):
                left, right = symbol.get(name[:cut]), symbol.get(name[cut:])
                if left is not None and right is not None:
                    pairs.append((left, right, rank_of[scores[i]], i))
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 4)
        self.width = size + len(extra) + 1
        self._slots(pairs)
        # a character: its symbol, or -1 if no piece holds it
        self.char = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        joining = np.zeros(0x110000, bool)
        for name in normal:
            if len(name) > 1:
                joining[[ord(c) for c in name]] = True
        self.joining = joining
        self.value = mix(np.arange(0x110000, dtype=U64) * U64(0xE7037ED1A0B428DB) + U64(77))
        self.other_value = mix(self.value + U64(0x9FB21C651E98DF25))
        # bytes of each piece as decoding shows them
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        shown = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_len = np.array([len(x) for x in shown])
        self.shown_at = np.concatenate([[0], np.cumsum(self.shown_len)])
        self.is_byte = np.array([sp.is_byte(i) for i in range(size)])
        self.leads = np.array([n.startswith(SPACE) for n in names]) & ~np.array(special)
        self.extra_bytes = {i: c.encode() for c, i in extra.items()}
        # long runs of spaces: chunks that a run falls into from the left, if it is periodic
        self.period = 0
        run = self.merge(np.full(64, self.char[MARK], np.int32), np.array([0]))[0] if self.char[MARK] >= 0 else []
        if len(run) and 64 % len(run) == 0 and len(set(map(int, run))) == 1:
            self.period = 64 // len(run)
        self._forget()

    def _forget(self) -> None:
        self.cache_keys, self.cache_checks = np.zeros(0, U64), np.zeros(0, U64)
        self.cache_ids, self.cache_len = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _slots(self, pairs: np.ndarray) -> None:
        """An open hash table of the pairs, probed at most `probes` times."""
        key = (pairs[:, 0] * self.width + pairs[:, 1]).astype(U64)
        bits = max(4, int(np.ceil(np.log2(max(1, len(key)) * 4))))
        self.shift = U64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, 2**64 - 1, U64)
        self.slot_rank = np.full(len(self.slot_key), NONE, np.int32)
        self.slot_to = np.zeros(len(self.slot_key), np.int32)
        left, self.probes = np.arange(len(key)), 0
        home = self._home(key)
        while len(left):
            at = home[left] + self.probes
            free = self.slot_key[at] == U64(2**64 - 1)
            _, first = np.unique(at, return_index=True)
            ok = np.zeros(len(left), bool)
            ok[first] = True
            ok &= free
            put = left[ok]
            self.slot_key[at[ok]], self.slot_rank[at[ok]], self.slot_to[at[ok]] = key[put], pairs[put, 2], pairs[put, 3]
            left = left[~ok]
            self.probes += 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the join of each pair (NONE if it is no piece), and the piece."""
        key = left.astype(np.int64) * self.width + right
        key = np.where((left < 0) | (right < 0), 0, key).astype(U64)
        at = self._home(key)
        rank, to = np.full(len(key), NONE, np.int32), np.zeros(len(key), np.int32)
        for probe in range(self.probes):
            slot = at + probe
            hit = self.slot_key[slot] == key
            rank[hit], to[hit] = self.slot_rank[slot[hit]], self.slot_to[slot[hit]]
        rank[(left < 0) | (right < 0)] = NONE
        return rank, to

    def merge(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of words that begin at starts, and the number of them in each word."""
        n_words = len(starts)
        lengths = np.diff(np.append(starts, len(sym)))
        done_sym: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        word = np.repeat(np.arange(n_words), lengths)
        rank, to = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        if len(sym):
            rank[:-1], to[:-1] = self.look(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = NONE
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(sym)))
            if (least == NONE).any():
                out = np.repeat(least == NONE, count)
                done_sym.append(sym[out])
                done_word.append(word[out])
                stay = ~out
                sym, word, rank, to = sym[stay], word[stay], rank[stay], to[stay]
                keep = least != NONE
                least, count = least[keep], count[keep]
                if not len(sym):
                    break
                begin = np.concatenate([[0], np.cumsum(count)[:-1]])
            chosen = np.flatnonzero(rank == np.repeat(least, count))
            # of pairs that overlap, every second one from the left
            fresh_run = np.concatenate([[True], np.diff(chosen) != 1])
            run_start = np.flatnonzero(fresh_run)
            offset = np.arange(len(chosen)) - np.repeat(run_start, np.diff(np.append(run_start, len(chosen))))
            chosen = chosen[offset % 2 == 0]
            made, of = to[chosen], word[chosen]
            several = np.zeros(len(chosen), bool)
            same = of[1:] == of[:-1]
            several[1:] |= same
            several[:-1] |= same
            if several.any():
                # would a pair made by one of these merges come before the others?
                pick = np.flatnonzero(several)
                pos, m, w = chosen[pick], made[pick], of[pick]
                before = np.maximum(pos - 1, 0)
                left = sym[before].copy()
                joined = np.zeros(len(pick), bool)
                joined[1:] = (np.diff(pos) == 2) & (np.diff(w) == 0)
                left[joined] = m[np.flatnonzero(joined) - 1]
                left[(pos == 0) | (word[before] != w)] = -1
                after = np.minimum(pos + 2, len(sym) - 1)
                right = np.where((pos + 2 < len(sym)) & (word[after] == w), sym[after], -1)
                bar = rank[pos]
                unsafe = (self.look(left, m)[0] <= bar) | (self.look(m, right)[0] <= bar)
                if unsafe.any():
                    bad = np.isin(of, w[unsafe])
                    first = np.concatenate([[True], of[1:] != of[:-1]])
                    ok = ~bad | first
                    chosen, made = chosen[ok], made[ok]
            sym[chosen] = made
            keep = np.ones(len(sym), bool)
            keep[chosen + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            at = place[chosen]
            at = np.unique(np.concatenate([at, at[at > 0] - 1]))
            inner = at[at + 1 < len(sym)]
            rank[at] = NONE
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner], to[inner] = self.look(sym[inner], sym[inner + 1])
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(n_words, np.int64)
        s, w = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(w, kind="stable")
        return s[order], np.bincount(w, minlength=n_words)

    def ids_of(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and their number in each."""
        lengths = ends - starts
        chars = codes[ragged(starts, lengths)]
        sym, count = self.merge(self.char[chars], np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64))
        bare = (sym < 0) | (sym >= self.size)
        if not bare.any():
            return sym, count
        # characters without a piece: their bytes
        owner = np.repeat(np.arange(len(count)), count)
        # a word with such a symbol of value -1 is that one character alone
        lone = chars[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)]
        raw = [self.extra_bytes[int(s)] if s >= 0 else chr(int(lone[o])).encode() for s, o in zip(sym[bare], owner[bare])]
        width = np.ones(len(sym), np.int64)
        width[bare] = [len(x) for x in raw]
        out = np.repeat(sym, width)
        out[np.repeat(bare, width)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(np.repeat(owner, width), minlength=len(count))

    def words(self, codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
        """Where the independently merging words of marked texts begin."""
        mark = codes == MARK
        first = np.zeros(len(codes), bool)
        first[doc_starts] = True
        first[1:] |= mark[1:] & ~mark[:-1]
        alone = ~self.joining[codes]
        first |= alone
        first[1:] |= alone[:-1]
        starts = np.flatnonzero(first)
        if self.period:
            # leading whole periods of a long run of marks stand alone
            run = np.flatnonzero(mark & np.concatenate([[True], ~mark[:-1] | first[1:]]))
            stop = np.flatnonzero(mark & np.concatenate([~mark[1:] | first[1:], [True]])) + 1
            size = stop - run
            long = size > 2 * self.period
            if long.any():
                pieces = (size[long] - self.period - 1) // self.period
                more = np.repeat(run[long], pieces) + self.period * (ragged(np.zeros(len(pieces), np.int64), pieces) + 1)
                starts = np.union1d(starts, more)
        return starts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts without begin and end, and the number in each text."""
        marked = "".join(SPACE + t for t in texts if t).replace(" ", SPACE)
        codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        starts = self.words(codes, begin[sizes > 0])
        ends = np.append(starts[1:], len(codes))
        key = span_hashes(self.value[codes], starts, ends)
        check = span_hashes(self.other_value[codes], starts, ends, SEQ_BASE)
        distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.cache_keys, distinct)
        place[place == len(self.cache_keys)] = 0
        known = self.cache_keys[place] == distinct if len(self.cache_keys) else np.zeros(len(distinct), bool)
        if (check != check[at][back]).any() or (self.cache_checks[place[known]] != check[at][known]).any():
            # different words with one first hash: each pair of hashes by itself, beside the memory
            order = np.lexsort([check, key])
            head = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])])
            at, slot = order[head], np.empty(len(key), np.int64)
            slot[order] = np.cumsum(head) - 1
            all_ids, all_len = self.ids_of(codes, starts[at], ends[at])
        else:
            new = np.flatnonzero(~known)
            if len(new):
                ids, count = self.ids_of(codes, starts[at[new]], ends[at[new]])
                self._remember(distinct[new], check[at[new]], ids, count)
                place = np.searchsorted(self.cache_keys, distinct)
            slot, all_ids, all_len = place[back], self.cache_ids, self.cache_len
        offset = np.cumsum(all_len) - all_len
        count = all_len[slot]
        ids = all_ids[ragged(offset[slot], count)]
        total = np.concatenate([[0], np.cumsum(count)])
        bound = total[np.searchsorted(starts, np.append(begin, len(codes)))]
        per = np.diff(bound)
        per[sizes == 0] = 0
        if len(self.cache_keys) > CACHE_WORDS:
            self._forget()
        return ids, per

    def _remember(self, keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        all_keys = np.concatenate([self.cache_keys, keys])
        all_len = np.concatenate([self.cache_len, count])
        all_ids = np.concatenate([self.cache_ids, ids])
        offset = np.cumsum(all_len) - all_len
        order = np.argsort(all_keys, kind="stable")
        self.cache_keys, self.cache_len = all_keys[order], all_len[order]
        self.cache_checks = np.concatenate([self.cache_checks, checks])[order]
        self.cache_ids = all_ids[ragged(offset[order], all_len[order])]

    def decode(self, ids: np.ndarray, per: np.ndarray) -> list[bytes]:
        """The text of each sequence of ids (begin and end ids show nothing), as UTF-8."""
        size = self.shown_len[ids]
        flat = self.shown[ragged(self.shown_at[ids], size)].tobytes()
        edge = np.concatenate([[0], np.cumsum(size)])
        stop = np.cumsum(per)
        out = []
        for lo, hi in zip(stop - per, stop):
            raw = flat[edge[lo] : edge[hi]]
            own = ids[lo:hi]
            visible = np.flatnonzero((own != self.bos) & (own != self.eos))[:1]
            if len(visible) and self.leads[own[visible[0]]]:
                raw = raw[1:]
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = self._repaired(own)
            out.append(raw)
        return out

    def _repaired(self, ids: np.ndarray) -> bytes:
        """Decoding where byte pieces form no valid UTF-8: each wrong byte becomes U+FFFD."""
        out, run, first = [], bytearray(), True

        def flush():
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + n]).decode().encode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    i += 1
            run.clear()

        for i in map(int, ids):
            if i in (self.bos, self.eos):
                continue
            shown = self.shown[self.shown_at[i] : self.shown_at[i + 1]].tobytes()
            if self.is_byte[i]:
                run += shown
            else:
                flush()
                out.append(shown[1:] if first and self.leads[i] else shown)
            first = False
        flush()
        return b"".join(out)


@lru_cache(maxsize=2)
def tables(proto: bytes) -> PieceTables:
    return PieceTables(proto)


def text_groups(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    row = 0
    while row < len(texts):
        stop, size = row, 0
        while stop < len(texts) and (stop == row or size + len(texts[stop]) <= limit):
            size += len(texts[stop])
            stop += 1
        yield row, stop
        row = stop


def encode_decode(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """docs with `piece_ids` (ids with begin and end, packed as little-endian unsigned
    32-bit integers) and `decoded` (the text that decoding gives back)."""
    with open(model or default_model(), "rb") as f:
        proto = f.read()
    ids_name, decoded_name = fresh(docs, "piece_ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids_name, T.BinaryType()), T.StructField(decoded_name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables(proto)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_utf8()).fill_null("").to_pylist()
            for lo, hi in text_groups(texts):
                ids, per = t.encode(texts[lo:hi])
                # begin and end ids around each text
                stop = np.cumsum(per)
                ids = np.insert(ids, np.stack([stop - per, stop], 1).ravel(), np.tile([t.bos, t.eos], hi - lo))
                per = per + 2
                raw, edge = ids.astype("<u4").tobytes(), 4 * np.concatenate([[0], np.cumsum(per)])
                packed = [raw[edge[i] : edge[i + 1]] for i in range(hi - lo)]
                shown = pa.array(t.decode(ids, per), pa.binary()).cast(pa.string())
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(packed, pa.binary()), shown], names=[*part.schema.names, ids_name, decoded_name])

    return docs.mapInArrow(run, schema)


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs).select(
        "doc_id",
        (F.octet_length("piece_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("piece_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

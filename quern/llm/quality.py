"""Line-first quality rules: judge each line, remove the lines that fail, then reject documents that lose too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.llm.common import SPACES, joined_bytes, map_texts, mix64, text_slices, text_words, window_hashes, word_hashes

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_failed_lines long, n_kept_words long"
#: A line ends well with one of these, or with one of them before closing quotes or brackets; so does one in which a sentence ends.
ENDINGS = tuple(".!?:;…。！？؟") + tuple(a + b for a in ".!?…" for b in "\"'”’»)]")
SEPARATORS = "|»›·•→"
SYMBOLS = b"#*$%&<>|"
# Phrases of page furniture in English, German, French and Spanish, in lower case; a line of few words that has one is boilerplate.
FURNITURE = (
    "cookie", "javascript", "lorem ipsum",
    "privacy policy", "terms of use", "terms of service", "all rights reserved", "subscribe to", "sign in", "sign up", "log in", "login", "click here", "read more", "follow us", "share this", "back to top",
    "datenschutzerkl\u00e4rung", "impressum", "nutzungsbedingungen", "alle rechte vorbehalten", "newsletter abonnieren", "jetzt anmelden", "hier klicken", "weiterlesen", "folgen sie uns", "nach oben",
    "politique de confidentialit\u00e9", "mentions l\u00e9gales", "conditions d'utilisation", "tous droits r\u00e9serv\u00e9s", "abonnez-vous", "se connecter", "cliquez ici", "lire la suite", "suivez-nous", "haut de page",
    "pol\u00edtica de privacidad", "aviso legal", "t\u00e9rminos de uso", "todos los derechos reservados", "suscr\u00edbete", "iniciar sesi\u00f3n", "haga clic aqu\u00ed", "leer m\u00e1s", "s\u00edguenos", "volver arriba",
)
#: At word ends, so that no other word is taken for one of them; forms like cookies count.
BOILERPLATE = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, FURNITURE))})(?:s|n|es)?(?!\w)")
_SENTENCE = re.compile(r"\w[.!?][\"')\]]? +\w")
_WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))


def line_fails(line: str) -> str | None:
    """The rule that a line breaks: navigation, symbols, shouting, boilerplate, punctuation; None if it breaks none, or has no word."""
    bare = line.strip(" \t\n\x0b\x0c\r")
    if not bare:
        return None
    n = bare.count(" ") + 1
    marks = sum(map(bare.count, SEPARATORS))
    if marks >= 2 and marks * 5 >= n:
        return "navigation"
    if sum(map(bare.count, "#*$%&<>")) * 20 > len(bare):
        return "symbols"
    if n >= 5 and (bare.isupper() or bare.count("!!") * 3 > n):
        return "shouting"
    if n <= 20 and BOILERPLATE.search(bare.lower()):
        return "boilerplate"
    if n >= 3 and not bare.endswith(ENDINGS) and not _SENTENCE.search(bare):
        return "punctuation"
    return None


def judge_lines(text: str) -> tuple[int, int, int, str]:
    """Lines with a word, lines that fail, words of the lines kept, and the text of the lines kept (blank lines stay)."""
    lines = text.split("\n")
    n = failed = words = 0
    kept = []
    for line in lines:
        if line_fails(line) is None:
            kept.append(line)
            if line and (w := len(_WORD.findall(line))):
                n += 1
                words += w
        else:
            n += 1
            failed += 1
    return n, failed, words, text if not failed else "\n".join(kept)


def repeated_words(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document, its words that stand in a window of three words found twice or more in that document."""
    if len(hashes) < 3:
        return np.zeros(n_docs, np.int64)
    windows = window_hashes(hashes, 3)
    inside = doc[:-2] == doc[2:]
    windows = mix64(windows + doc[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[inside]
    _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(inside)[count[back] > 1]
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[at + k] = True
    return np.bincount(doc[covered], minlength=n_docs)


def judge_texts(ids: pa.Array, texts: pa.Array, min_words: int, max_repeat_pct: int, max_lost: float) -> dict:
    """The columns of SCHEMA, and text, for some documents."""
    data, at = joined_bytes(texts)
    hashes, first = word_hashes(text_words(texts))
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    n_docs = len(at) - 1
    n_words = np.diff(first)
    total = lambda mask: np.add.reduceat(mask.astype(np.int64), at[:-1])
    repeat = repeated_words(hashes, doc, n_docs)
    judged, dups = [], []
    for text in texts.to_pylist():
        judged.append(judge_lines(text or ""))
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        dups.append(len(lines) - len(set(lines)))
    lines, failed, kept_words, cleaned = zip(*judged)
    base = (n_words < min_words) | (100 * repeat > max_repeat_pct * n_words)
    kept = ~base & (n_words - np.array(kept_words) <= max_lost * n_words)
    out = {"doc_id": ids, "n_words": n_words, "word_chars": total(~_SPACE[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[data]), "n_dup_lines": dups, "n_repeat_words": repeat, "base_failed": base, "kept": kept}
    return out | {"n_lines": lines, "n_failed_lines": failed, "n_kept_words": kept_words, "text": pa.array(cleaned, pa.string())}


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_pct: int = 50, max_lost: float = 0.3, with_text: bool = False) -> DataFrame:
    """One row per input row: counts, base_failed, kept (and text, the lines kept, if with_text).

    Lines are judged first (line_fails); a document is rejected if base_failed (fewer than min_words words, or more than
    max_repeat_pct percent of its words in repeated three-word windows), or if failing lines hold more than max_lost of its words.
    Nulls and empty texts: no words, rejected. Ties and repeated rows: each row is judged alone. Other columns are not read."""
    return map_texts(df, id_col, text_col, SCHEMA + ", text string" * with_text, lambda ids, texts: judge_texts(ids, texts, min_words, max_repeat_pct, max_lost))


def keep_clean(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars", min_words: int = 50, max_repeat_pct: int = 50, max_lost: float = 0.3) -> DataFrame:
    """The rows of df that quality_rules keeps, with all columns of df; text_col has only the lines kept, and chars_col, if there, their code points, in its own type."""
    columns, types = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch, text_col):
                part = batch.slice(first, last - first)
                out = judge_texts(part.column(text_col), part.column(text_col), min_words, max_repeat_pct, max_lost)
                new = {text_col: out["text"]}
                if chars_col in columns:
                    new[chars_col] = pc.utf8_length(out["text"]).cast(part.column(chars_col).type)
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in columns], columns).filter(pa.array(out["kept"]))

    return df.mapInArrow(run, types)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents kept, without the lines that fail; the columns of docs. Null and empty texts are rejected; an empty table gives an empty one."""
    return keep_clean(docs)

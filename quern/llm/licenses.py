"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases; a shunting-yard parser evaluates licence expressions."""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import map_texts

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, freedom double"
# The phrases of the contract, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Further phrases of public licence notices, and their labels.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this software is provided as is without any express or implied warranty": "zlib",
    "boost software license version 1": "bsl-1",
    "released under the apache license": "apache-2",
    "licensed under the apache license": "apache-2",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "common development and distribution license": "cddl",
    "microsoft public license": "ms-pl",
    "academic free license": "afl",
    "artistic license": "artistic",
    "open software license": "osl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "do what the fuck you want to public license": "wtfpl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc",
    "cc by nc nd": "cc-by-nc",
    "creative commons zero": "public-domain",
    "cc0": "public-domain",
    "dedicated to the public domain": "public-domain",
    "released into the public domain": "public-domain",
    "open database license": "odbl",
    "sil open font license": "ofl",
    "business source license": "busl",
    "server side public license": "sspl",
    "all rights reserved": "proprietary",
}
# SPDX identifiers, lower-cased, without -only, -or-later and +, by the label that they get.
BY_LABEL = {
    "mit": "mit mit-0 x11 expat", "isc": "isc", "zlib": "zlib libpng", "bsl-1": "bsl-1.0", "bsd": "0bsd bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause", "ncsa": "ncsa", "postgresql": "postgresql", "python": "psf-2.0 python-2.0",
    "apache-2": "apache-2.0", "apache-1": "apache-1.0 apache-1.1", "artistic": "artistic-1.0 artistic-2.0", "wtfpl": "wtfpl", "unicode": "unicode-dfs-2016 unicode-3.0", "openssl": "openssl", "php": "php-3.0 php-3.01", "w3c": "w3c w3c-20150513",
    "gpl": "gpl-1.0", "gpl-2": "gpl-2.0", "gpl-3": "gpl-3.0", "lgpl": "lgpl-2.0 lgpl-2.1 lgpl-3.0", "agpl": "agpl-1.0 agpl-3.0", "gfdl": "gfdl-1.1 gfdl-1.2 gfdl-1.3", "mpl": "mpl-1.0 mpl-1.1 mpl-2.0", "epl": "epl-1.0 epl-2.0", "eupl": "eupl-1.0 eupl-1.1 eupl-1.2",
    "cddl": "cddl-1.0 cddl-1.1", "cpl": "cpl-1.0", "ms-pl": "ms-pl", "ms-rl": "ms-rl", "afl": "afl-1.1 afl-2.0 afl-2.1 afl-3.0", "osl": "osl-1.0 osl-2.0 osl-2.1 osl-3.0", "upl": "upl-1.0", "vim": "vim", "ofl": "ofl-1.0 ofl-1.1", "odbl": "odbl-1.0", "odc-by": "odc-by-1.0", "busl": "busl-1.1", "sspl": "sspl-1.0",
    "cc-by": "cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0", "cc-by-sa": "cc-by-sa-1.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0", "cc-by-nd": "cc-by-nd-1.0 cc-by-nd-2.0 cc-by-nd-2.5 cc-by-nd-3.0 cc-by-nd-4.0",
    "cc-by-nc": "cc-by-nc-1.0 cc-by-nc-2.0 cc-by-nc-2.5 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-sa-2.0 cc-by-nc-sa-2.5 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nc-nd-2.0 cc-by-nc-nd-2.5 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0",
    "public-domain": "cc0-1.0 unlicense pddl-1.0 cc-pddc",
}
IDENTIFIERS = {name: label for label, names in BY_LABEL.items() for name in names.split()}
# How free a licence leaves who uses the text, from 1 (no duty) to 0; an order of our own, for choosing where an expression leaves a choice.
BY_FREEDOM = {
    1.0: "public-domain", 0.95: "wtfpl", 0.9: "mit isc zlib bsl-1 bsd ncsa postgresql python apache-2 apache-1 unicode openssl php w3c upl vim", 0.8: "cc-by odc-by artistic afl ofl", 0.6: "mpl epl eupl cddl cpl ms-pl ms-rl", 0.5: "lgpl",
    0.4: "cc-by-sa odbl gfdl", 0.3: "gpl gpl-2 gpl-3 osl", 0.2: "agpl", 0.1: "cc-by-nd cc-by-nc busl sspl", 0.0: "proprietary",
}
FREEDOM = {label: free for free, labels in BY_FREEDOM.items() for label in labels.split()}
TAG = "spdx license identifier"
_TAGGED = re.compile(r"spdx-license-identifier:[ \t]*([^\n]*)", re.I | re.A)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+", re.A)
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def lower_az(text: str) -> str:
    """A-Z to a-z, and nothing else."""
    return text.lower() if text.isascii() else text.encode().lower().decode()


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: the names and operators of a licence expression in postfix order, lower-cased; None if it isn't well-formed.

    The expression ends where a name, or an opening bracket, follows a name: what comes then is other text."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in _TOKEN.findall(expression):
        token = lower_az(token).rstrip(".:")
        if not token:
            continue
        if token in _PRECEDENCE or token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(" and (token == ")" or _PRECEDENCE[stack[-1]] >= _PRECEDENCE[token]):
                out.append(stack.pop())
            if token == ")":
                if not stack:
                    return None
                stack.pop()
            else:
                stack.append(token)
                operand = False
        elif operand:
            break
        elif token == "(":
            stack.append(token)
        else:
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def label_of(name: str) -> str | None:
    """The label of a licence's name in an expression; None for names that aren't identifiers."""
    return IDENTIFIERS.get(re.sub(r"(-only|-or-later|\+)$", "", name))


def evaluate(postfix: list[str]) -> tuple[float, frozenset[str]] | None:
    """How free an expression leaves its user, and the labels that then apply; None if it names no known licence.

    and: the duties of both, so the lesser freedom and all labels. or: the side that leaves more freedom (of two as free, the one with fewer
    labels, then the first by name). with: an exception leaves the licence as it is. A name that isn't known leaves no choice for it: beside
    or, the other side applies; beside and, the other side's labels apply without any freedom."""
    stack: list[tuple[float, frozenset[str]] | None] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            label = label_of(token)
            stack.append(None if label is None else (FREEDOM[label], frozenset([label])))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":
            stack.append(a)
        elif a is None or b is None:
            known = a or b
            stack.append(known if token == "or" or known is None else (0.0, known[1]))
        elif token == "and":
            stack.append((min(a[0], b[0]), a[1] | b[1]))
        else:
            stack.append(min(a, b, key=lambda x: (-x[0], len(x[1]), sorted(x[1]))))
    return stack[0]


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrases, base in ((NOTICES, False), (BASE, True)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (phrase, label, base))
    found.add_word(f" {TAG} ", (TAG, None, False))
    found.make_automaton()
    return found


def scan(text: str) -> tuple:
    """The values of SCHEMA after doc_id for one text."""
    words = _WORD.findall(lower_az(text))
    line = " " + " ".join(words) + " "
    starts, base, own, expressions = [], set(), set(), []
    tagged = False
    for end, (phrase, label, is_base) in automaton().iter(line):
        if label is None:
            tagged = True
        elif is_base:
            starts.append((end - len(phrase) - 1, label))
            base.add(label)
        else:
            own.add(label)
    notices = len(own)
    freedom = [FREEDOM[x] for x in base | own]
    certain = False
    if tagged:
        for m in _TAGGED.finditer(text):
            if (postfix := to_postfix(m[1].split("*/")[0])) is not None and (found := evaluate(postfix)) is not None:
                expressions.append(" ".join(postfix))
                freedom.append(found[0])
                own |= found[1]
                certain = certain or all(x in _PRECEDENCE or label_of(x) for x in postfix)
    places = sorted(place for place, _ in starts)
    at = [line.count(" ", 0, places[0]), line.count(" ", 0, places[-1])] if places else [None, None]
    score = 1.0 if certain else 1.0 - 0.5 ** (len(places) + notices + len(expressions))
    return len(words), len(places), *at, ",".join(sorted(base)), ",".join(sorted(base | own)), score, "; ".join(expressions) or None, min(freedom, default=None)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words, places of base phrases, labels, score, the postfix form of tagged expressions, and freedom (the least of all notices and expressions, null without any).

    Tagged expressions are evaluated: MIT OR GPL-2.0 gives the label mit, MIT AND GPL-2.0 gives both and less freedom. Only known identifiers give labels.
    score is 1 with a tagged expression of known names only, else 1 - 2**-n for n places, notices and expressions.
    Null texts are empty: no word, no label, score 0. Repeated rows are scanned alone; other columns are not read. A tag whose expression
    isn't well-formed adds no label. Long texts and lines are read once: the work grows with their length."""
    names = [x.split()[0] for x in SCHEMA.split(",")][1:]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.float64()]

    def rows(ids: pa.Array, texts: pa.Array) -> dict:
        found = zip(*(scan(x or "") for x in texts.to_pylist()))
        return {"doc_id": ids} | {k: pa.array(v, t) for k, v, t in zip(names, found, types)}

    return map_texts(df, id_col, text_col, SCHEMA, rows)


def op4_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Personal data: an Aho-Corasick automaton finds anchors, local parsers expand and validate what stands around them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_with_ids

#: Base kinds in the order of the digest, then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "account")
KINDS = BASE + ADDED

SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = ("iban", "ssn", "social security", "passport", "account", "acct", "tax id", "driver license")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9._~:/?#@!$&'()*+,;=%\[\]-]+")
ACCOUNT = re.compile(r"[\x20]?(?i:number|no|nr)?[.:#=\x20]{1,3}([A-Za-z0-9](?:[\x20-]?[A-Za-z0-9]){0,47})")


def automaton() -> ahocorasick.Automaton:
    """Anchors in lower case; it reads what :func:`lowered` gives."""
    found = ahocorasick.Automaton()
    for c in "0123456789":
        found.add_word(c, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    for kind, strings in (("scheme", SCHEMES), ("cue", CUES)):
        for s in strings:
            found.add_word(s, (kind, len(s)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """``text`` with A-Z alone in lower case, so that all offsets stay."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban(value: str) -> bool:
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def account(value: str) -> bool:
    """A plausible number behind a cue: a valid IBAN, or 6 to 20 characters, most of them digits."""
    bare = re.sub(r"[\x20-]", "", value)
    digits = sum(c.isdigit() for c in bare)
    return iban(bare.upper()) or (6 <= len(bare) <= 20 and digits >= 5 and 2 * digits > len(bare))


def spans(text: str, anchors: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by kind as in KINDS, then by start.

    The parsers read each position a bounded number of times: every anchor is skipped that lies in what its kind has
    consumed, and a run that fails is left as a whole, as no match can begin inside it.
    """
    out: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    email_from = ip_from = card_from = url_from = account_from = 0
    for last, (anchor, length) in anchors.iter(lowered(text)):
        at = last - length + 1
        if anchor == "digit":
            if at >= card_from:
                m = CARD.match(text, at)
                card_from = m.end() if m else at + 1
                if m:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append(("card", at, m.end()))
            if at >= ip_from:
                m = IP.match(text, at)
                ip_from = m.end() if m else DIGITS.match(text, at).end()
                if m and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                    out["ip"].append(("ip", at, m.end()))
        elif anchor == "at":
            start = at
            while start > email_from and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email_from = m.end()
                out["email"].append(("email", start, m.end()))
        elif anchor == "plus":
            m = PHONE.match(text, at)
            if m and 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out["phone"].append(("phone", at, m.end()))
        elif anchor == "scheme":
            if at >= url_from and (m := URL.match(text, last + 1)):
                url_from = m.end()
                end = last + 1 + len(m.group().rstrip(".,;:!?)]'"))
                if end > last + 1:
                    out["url"].append(("url", at, end))
        elif at >= account_from and (at == 0 or not text[at - 1].isalnum()):
            m = ACCOUNT.match(text, last + 1)
            if m:
                # the longest lead of the blank-separated groups that is a valid number; a group that goes on is left out
                value, end = m.group(1), m.end()
                whole = text[end : end + 1] == "" or not (text[end].isascii() and text[end].isalnum())
                while True:
                    if whole and account(value):
                        out["account"].append(("account", m.start(1), end))
                        account_from = end
                        break
                    cut = max(value.rfind(" "), value.rfind("-"))
                    if cut < 1:
                        break
                    value, end, whole = value[:cut], m.start(1) + cut, True
    return [s for k in KINDS for s in out[k]]


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text of ``docs(doc_id, text)``.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url, n_account. Null and empty texts have no
    spans: counts 0, spans '' and the digest of ''. Repeated rows and null doc_ids give a row each.
    Very long texts are read whole; an empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                found = spans(text, anchors) if text else []
                base = joined([s for s in found if s[0] in BASE])
                counts = [sum(s[0] == k for s in found) for k in KINDS]
                rows.append((*counts[:4], hashlib.sha256(base.encode()).hexdigest(), joined(found), *counts[4:]))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_url", "n_account"])
            out.insert(0, "doc_id", pdf["doc_id"].values)
            yield out

    return map_with_ids(docs.select("doc_id", "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_url long, n_account long", "doc_id")


def redact(docs: DataFrame, mask: str = "[{}]") -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; columns stay. Overlapping spans become one, named for the first.

    Adjusts ``n_chars`` if there is such a column. Null text stays null.
    """
    def cleaned(text: str, anchors: ahocorasick.Automaton) -> str:
        done, pieces = 0, []
        for kind, a, b in sorted(spans(text, anchors), key=lambda s: (s[1], -s[2])):
            if a >= done:
                pieces += [text[done:a], mask.format(kind.upper())]
            done = max(done, b)
        return "".join([*pieces, text[done:]]) if pieces else text

    @F.pandas_udf("string")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        anchors = automaton()
        for s in parts:
            yield s.map(lambda t: cleaned(t, anchors) if t else t)

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)

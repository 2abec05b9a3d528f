"""Secret scans: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_ids, map_with_ids, written

#: Short names of passwords. They count as a whole part of a name alone, as in ``pw``, ``DB_PASS`` or ``admin-pw``.
SHORT_WORDS = ("pw", "psw", "pass", "cred", "creds")
#: Words beside a candidate that name a secret, or a harmless value.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential", "private")
BENIGN_WORDS = ("sha", "sha1", "sha256", "md5", "checksum", "commit", "digest", "uuid", "id", "hash", "etag", "revision", "example", "placeholder", "page", "integrity")
#: Published prefixes of issued keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "ya29.", "eyJ", "SG.")
#: Secret words that may end a longer name, as in ``db_password`` or ``clientSecret``.
ENDINGS = ("token", "secret", "password", "passwd", "pwd", "apikey", "_key", "-key", "credential", "credentials", "accesskey", "privatekey")
FEATURES = (
    "length", "entropy", "transitions", "digit_share", "upper_share", "lower_share", "vowel_share", "bigram", "dictionary",
    "hex_only", "quoted", "assigned", "secret_word", "benign_word", "prefix", "path_word", "path_test",
    "login", "encoded", "pieces", "template",
)
#: Characters read on either side.
AROUND = 48
#: Whole runs of the characters keys are made of. A run is read once: it is possessive and begins where no other run ends.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Tokens that hold dots or are known by their prefix; a dot that ends a sentence is none of theirs.
ISSUED = re.compile(r"(?<![A-Za-z0-9+/_.-])(?:" + "|".join(map(re.escape, PREFIXES)) + r")(?:[A-Za-z0-9+/_-]|\.(?=[A-Za-z0-9+/_-])){8,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: A name and what assigns to it; whether the name holds a secret word is looked up.
LEAD = re.compile(r"(?<![\w-])([\w-]++)[\"'\]]{0,2}[\x20\t]*+(?:=>|:=|={1,3}|:)[\x20\t]*+(?:(?i:bearer|basic|token)[\x20\t]++)?")
NAMES = re.compile("|".join(SECRET_WORDS) + r"|(?<![^\W_])(?:" + "|".join(SHORT_WORDS) + r")(?![^\W_])", re.I)
#: The user of a URL with a password, and the password up to the host.
LOGIN = re.compile(r"://[^\s/:@?#\"'`<>]*+:")
PASSWORD = re.compile(r"[^\s/@\"'`]{4,}+(?=@)")
#: What stands for a value that is filled in later: <name>, ${name}, {{name}}, %(name)s, %NAME%, $NAME, or one character repeated.
TEMPLATE = re.compile(r"<[^<>]*>|\$?\{.*\}|%\(\w+\)s|%\w+%|\$[A-Z_]+|(.)\1*", re.S)
#: Openings of encoded pictures and fonts, and of subresource digests.
ENCODED = re.compile(r"iVBORw0KGgo|/9j/|R0lGOD|UklGR|d09GR|PHN2Zy|sha(?:1|256|384|512)-")
#: Parts of an identifier: capitals, or lower-case letters behind at most one capital.
PIECE = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])")
#: Letters that can be said: a vowel, and no more than four consonants in a row.
VOWEL, CONSONANTS = re.compile(r"[aeiouy]", re.I), re.compile(r"[^aeiouy]{5}", re.I)
#: Assigned values: in quotes, or up to a blank or quote without the punctuation behind.
IN_QUOTES = {q: re.compile(rf"(?:[^{q}\\\r\n]|\\.){{8,}}+(?={q})") for q in "\"'`"}
BARE = re.compile(r"[^\s\"'`]{7,}[^\s\"'`.,;:!?)\]}>]")


class Candidates:
    """What can be a secret: runs of 16 key characters or more, issued tokens, values of 8 characters or more that are
    assigned to a name with a secret word, and passwords of 4 characters or more in URLs. None has a largest length."""

    @staticmethod
    def logins(text: str) -> Iterator[re.Match[str]]:
        for m in LOGIN.finditer(text):
            if value := PASSWORD.match(text, m.end()):
                yield value

    @staticmethod
    def assigned(text: str) -> Iterator[re.Match[str]]:
        upto = 0
        for m in LEAD.finditer(text):
            at = m.end()
            if at < upto or not NAMES.search(m.group(1)):
                continue
            quote = text[at : at + 1]
            value = IN_QUOTES[quote].match(text, at + 1) if quote in IN_QUOTES else None
            value = value or BARE.match(text, at + (quote in IN_QUOTES))
            if value:
                upto = value.end()
                yield value

    def finditer(self, text: str) -> list[re.Match[str]]:
        """Matches in order, each span once. A value and a run inside it are both candidates."""
        found = {m.span(): m for ways in (RUN.finditer(text), ISSUED.finditer(text), self.assigned(text), self.logins(text)) for m in ways}
        return [found[span] for span in sorted(found)]


CANDIDATE = Candidates()


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


#: Words of letters alone, three or more, between characters that are neither letters, digits nor underscores.
LETTERS = r"(?<![\p{L}\p{N}_])\p{L}{3,}+(?![\p{N}_])"
#: Letter pairs counted are of these letters, so the alphabet bounds their number.
PAIR = r"^[a-z\u00df-\u017f]{2}$"
#: The longest word of a dictionary; a longer one is covered by its parts.
LONGEST = 32


@dataclass
class Language:
    """Letter pairs and words of ordinary text: what keys lack."""

    pairs: dict[str, float]
    words: frozenset[str]
    floor: float

    def __post_init__(self) -> None:
        lengths: dict[str, set[int]] = {}
        for w in self.words:
            lengths.setdefault(w[:3], set()).add(len(w))
        self.lengths = {head: sorted(of, reverse=True) for head, of in lengths.items()}

    def likelihood(self, s: str) -> float:
        s = s.lower()
        return sum(self.pairs.get(s[k : k + 2], self.floor) for k in range(len(s) - 1)) / max(1, len(s) - 1)

    def coverage(self, s: str) -> float:
        """Share of the letters in words of the dictionary, longest first from the left."""
        low, at, hit = s.lower(), 0, 0
        while at < len(low):
            for n in self.lengths.get(low[at : at + 3], ()):
                if at + n <= len(low) and low[at : at + n] in self.words:
                    hit, at = hit + n, at + n
                    break
            else:
                at += 1
        return hit / max(1, len(s))


def language(docs: DataFrame, *, share: float = 1e-5) -> Language:
    """Counts over all words of letters in all texts.

    The dictionary has each word of up to LONGEST letters that makes at least ``share`` of all words, which bounds it to
    1 / ``share`` words at any size of the table. Letter pairs are counted in all words, weighted by their counts.
    Null and empty texts have no words; without words the dictionary is empty.
    """
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)))
    counted = written(docs.select(word.alias("word")).groupBy("word").count(), "words")
    least = share * (counted.agg(F.sum("count")).first()[0] or 0)
    words = counted.where((F.col("count") >= least) & (F.length("word") <= LONGEST)).select("word").toPandas()["word"]
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.col("word").substr(k, F.lit(2))))
    spread = counted.select(pair.alias("pair"), "count").where(F.col("pair").rlike(PAIR)).groupBy("pair").agg(F.sum("count").alias("n"))
    pairs = {r.pair: r.n for r in spread.orderBy("pair").collect()}
    total = sum(pairs.values()) or 1
    return Language({p: math.log(n / total) for p, n in pairs.items()}, frozenset(words), math.log(0.1 / total))


def pieces(s: str) -> float:
    """Share of the characters in parts of a name that can be said, whatever the language."""
    found = (m.group() for m in PIECE.finditer(s))
    return sum(len(w) for w in found if len(w) > 2 and VOWEL.search(w) and not CONSONANTS.search(w)) / max(1, len(s))


def features(s: str, before: str, after: str, path: str, lang: Language) -> list[float]:
    n, counts, kinds = len(s), Counter(s), [kind(c) for c in s]
    near = re.findall(r"[a-z0-9_]+", (before[-AROUND:] + " " + after[:AROUND]).lower())
    lead = re.findall(r"[a-z0-9_]+", before[-AROUND:].lower())[-3:]
    where = re.findall(r"[a-z0-9]+", (path or "").lower())
    vowels = sum(c in "aeiouAEIOU" for c in s)
    return [
        min(n, 256), -sum(k / n * math.log2(k / n) for k in counts.values()), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, vowels / n, lang.likelihood(s), lang.coverage(s),
        float(re.fullmatch(r"[0-9a-fA-F]+", s) is not None), float(before[-1:] in "\"'" and before[-1:] != ""), float(re.search(r"[:=]\s*[\"']?$", before[-6:]) is not None),
        float(any(w in SECRET_WORDS or w.endswith(ENDINGS) or w.rpartition("_")[2] in SHORT_WORDS for w in lead)), float(any(w in BENIGN_WORDS for w in lead)), float(s.startswith(PREFIXES)),
        float(any(w in ("env", "config", "secret", "secrets", "credentials", "settings") for w in where)), float(any(w in ("test", "tests", "example", "examples", "docs", "fixture", "fixtures") for w in where) or any(w in ("example", "dummy", "fake") for w in near)),
        float(after.startswith("@") and re.search(r"://[^\s/:@]*:$", before[-AROUND:]) is not None), float(ENCODED.match(s) is not None or before.endswith("base64,")), pieces(s), float(TEMPLATE.fullmatch(s) is not None),
    ]


@dataclass
class Forest:
    """Trees as flat node arrays; a leaf points to itself and holds the share of secrets among its training rows."""

    roots: np.ndarray
    nodes: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not len(self.roots):
            return np.zeros(len(x))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.nodes[at, 0].astype(int)
            at = np.where(x[rows, f] <= self.nodes[at, 1], self.nodes[at, 2], self.nodes[at, 3]).astype(int)
        return self.nodes[at, 4].mean(axis=1)


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 8, least: int = 2, seed: int = 9) -> Forest:
    """Bootstrap samples, the square root of the features at each split, Gini impurity."""
    rng, nodes, roots = np.random.default_rng(seed), [], []
    some = max(1, round(math.sqrt(x.shape[1])))

    def grow(rows: np.ndarray, level: int) -> int:
        me, share = len(nodes), float(y[rows].mean())
        nodes.append([0, np.inf, me, me, share])
        if level == depth or len(rows) < 2 * least or share in (0.0, 1.0):
            return me
        best = (1e-12, -1, 0.0)
        parent = len(rows) * share * (1 - share)
        for j in rng.permutation(x.shape[1]):
            if best[1] >= 0 and some <= 0:
                break
            order = rows[np.argsort(x[rows, j], kind="stable")]
            v, hits = x[order, j], np.cumsum(y[order])
            n = np.arange(1, len(order))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(order) - n >= least)
            if not ok.any():
                continue
            left, right = hits[:-1], hits[-1] - hits[:-1]
            gain = parent - left * (1 - left / n) - right * (1 - right / (len(order) - n))
            gain = np.where(ok, gain, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), int(j), float((v[k] + v[k + 1]) / 2))
            seen.append(j)
            if len(seen) % some == 0 and best[1] >= 0:
                break
        if best[1] < 0:
            return me
        goes = x[rows, best[1]] <= best[2]
        nodes[me][:2] = [best[1], best[2]]
        nodes[me][2] = grow(rows[goes], level + 1)
        nodes[me][3] = grow(rows[~goes], level + 1)
        return me

    for _ in range(trees if len(y) else 0):
        seen: list[int] = []
        roots.append(grow(rng.integers(0, len(y), len(y)), 0))
    return Forest(np.array(roots, int), np.array(nodes).reshape(-1, 5), depth)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, path, start, end, value, before, after of each candidate in every whole text; offsets in code points."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, path in zip(pdf["doc_id"], pdf["text"], pdf["path"], strict=True):
                for m in CANDIDATE.finditer(text or ""):
                    a, b = m.span()
                    rows.append((doc_id, path, a, b, m.group(), text[max(0, a - AROUND) : a], text[b : b + AROUND]))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "start", "end", "value", "before", "after"])

    rows = docs.select("doc_id", "text", F.coalesce("path", F.lit("")).alias("path"))
    return map_with_ids(rows, run, "doc_id long, path string, start long, end long, value string, before string, after string", "doc_id")


def labelled(seed: int = 1, n: int = 3000) -> pd.DataFrame:
    """Labelled findings (value, before, after, path, label), generated: issued-looking keys in the places people leave
    them, and what scanners wrongly report: digests, identifiers, paths, long words, placeholders. Behind the ``n`` of these
    stand half as many short, long and dotted ones, and half as many in URLs, under short names, encoded or as identifiers."""
    rng = np.random.default_rng(seed)
    alpha = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda letters, k: "".join(letters[i] for i in rng.integers(0, len(letters), k))
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    parts = ("the", "con", "ver", "heit", "tion", "lich", "ment", "ing", "ara", "eux", "keit", "ous", "able", "ation", "schen", "mente", "dad", "que", "ere", "ung")
    rows = []
    for k in range(n):
        if k % 2:
            name = pick(("token", "api_key", "secret", "password", "auth_token", "client_secret", "TOKEN", "private_key"))
            value = pick((some("0123456789abcdef", pick((32, 40, 64))), some("0123456789ABCDEF", 40), some(alpha, pick((20, 32, 40, 48))), pick(PREFIXES[:9]) + some(alpha, 24), some(alpha + "+/", 40)))
            q = pick(('"', "'", "", '"'))
            rows.append((value, f"{pick(parts)} {name}{pick((' = ', '=', ': '))}{q}", q + " " + pick(parts), pick(("src/settings.py", "config/prod.env", "", "src4", "app/secrets.yml")), 1))
        else:
            case = int(rng.integers(0, 6))
            hexed = some("0123456789abcdef", pick((32, 40, 64)))
            uid = "-".join((hexed[:8], hexed[8:12], hexed[12:16], hexed[16:20], hexed[20:32]))
            word = "".join(pick(parts) for _ in range(int(rng.integers(5, 9))))
            value, before = (
                (hexed, pick(("commit ", "sha1: ", "md5=", "checksum ", "digest: "))), (uid, pick(("id: ", "uuid=", "request id "))), (word, pick(parts) + " "),
                (pick(("your_api_key_goes_here", "xxxxxxxxxxxxxxxxxxxxxxxx", "EXAMPLE_TOKEN_PLACEHOLDER", "changeme_changeme_changeme")), pick(("token = \"", "api_key: ", "secret="))),
                ("/".join(pick(parts) + pick(parts) for _ in range(4)), pick(("see ", "path: ", "in "))), (some("0123456789", int(rng.integers(16, 20))), pick(parts) + " "),
            )[case]
            rows.append((value, f"{pick(parts)} {before}", " " + pick(parts), pick(("tests/data.py", "docs/readme.md", "", "src4", "yarn.lock")), 0))
    # passwords, long keys and dotted tokens, and the ordinary values that stand in the same places
    word = lambda k: "".join(pick(parts) for _ in range(k))
    for k in range(n // 2):
        name = pick(("token", "api_key", "secret", "password", "db_password", "passwd", "pwd", "client_secret", "PASSWORD", "private_key", "credential", "auth"))
        before = f"{pick(parts)} {name}{pick((' = ', '=', ': '))}"
        if k % 2:
            mixed = word(int(rng.integers(1, 3))).capitalize()
            value = (
                some(alpha + "!@#$%^&*", int(rng.integers(8, 16))), f"{mixed[:2]}{some('0123456789', 1)}{mixed[2:]}{some('0123456789!@#$', int(rng.integers(3, 6)))}", some(alpha + "0123456789", int(rng.integers(8, 16))),
                some(alpha + "+/", int(rng.integers(500, 2500))) + pick(("", "=", "==")), some(alpha, int(rng.integers(500, 1500))),
                f"eyJ{some(alpha, 33)}.eyJ{some(alpha + '_-', int(rng.integers(40, 800)))}.{some(alpha + '_-', 43)}", f"SG.{some(alpha, 22)}.{some(alpha + '_-', 43)}", "ya29." + some(alpha + "_-", int(rng.integers(40, 200))),
            )[int(rng.integers(0, 8))]
            q = pick(('"', "'", "", '"'))
            if len(value) > 15 and not k % 5:
                before, q = f"{pick(parts)} ", ""
                value = value if value.startswith(PREFIXES) else pick(PREFIXES[:9]) + value[:40]
            rows.append((value, before + q, q + " " + pick(parts), pick(("src/settings.py", "config/prod.env", "", "src4", "app/secrets.yml")), 1))
        else:
            value, q = (
                (word(int(rng.integers(3, 5))), ""), (word(4).capitalize(), ""), (word(2) + " " + word(2) + " " + word(1), '"'), (pick(("required", "undefined", "optional", "changeme", "your_password", "<password>", "string,null", "os.environ", "********", "${PASSWORD}", "xxxxxxxx", "not_provided")), pick(('"', ""))),
                (pick("x=-_a0") * int(rng.integers(16, 3000)), ""), ("/".join(word(2) for _ in range(int(rng.integers(4, 60)))), ""), (".".join(word(2) for _ in range(3)), ""), ("-".join(word(2) for _ in range(4)), ""),
            )[int(rng.integers(0, 8))]
            rows.append((value, (before if len(value) < 60 else f"{pick(parts)} ") + q, q + " " + pick(parts), pick(("tests/data.py", "docs/readme.md", "", "src4", "src/settings.py")), 0))
    # logins in URLs and short names; encoded files, digests and identifiers
    names = ("user", "get", "profile", "settings", "element", "class", "cache", "page", "index", "order", "list", "view", "name", "date", "value", "data", "state", "handler", "version", "item")
    for k in range(n // 2):
        mixed, digits = word(int(rng.integers(1, 3))), some("0123456789", 3)
        if k % 2:
            value = (
                some(alpha, int(rng.integers(8, 20))), some(alpha + "!$%^&*", int(rng.integers(8, 16))), mixed[:2] + digits[:1] + mixed[2:] + digits[1:], mixed + digits[:1] + some("abcdefghijklmnopqrstuvwxyz", 1) + digits[1:2],
                mixed.translate(str.maketrans("aeio", "4310")).capitalize() + digits,
            )[int(rng.integers(0, 5))]
            q = pick(("", "", '"', "'"))
            before, after = (
                (f"{pick(parts)}{pick(('', '=', ' '))}{pick(('postgres', 'https', 'mysql', 'redis', 'amqp', 'mongodb+srv', 'ftp'))}://{pick((word(2), 'admin', 'root', ''))}:", f"@{word(2)}.{pick(('com', 'local', 'internal'))}/{pick(parts)}"),
                (f"{pick(parts)} {pick(('', 'db_', 'admin_'))}{pick(('pw', 'pass', 'psw', 'PW', 'PASS', 'creds'))}{pick((': ', '=', ' = '))}{q}", q + " " + pick(parts)),
            )[int(rng.integers(0, 2))]
            rows.append((value, before, after, pick(("src/settings.py", "config/prod.env", "", "src4", "app/secrets.yml")), 1))
        else:
            name = [pick(names) for _ in range(int(rng.integers(2, 6)))]
            camel, snake = name[0] + "".join(map(str.capitalize, name[1:])), "_".join(name) + pick(("", "_v2", "_v3", "_1"))
            picture = pick(("iVBORw0KGgo", "/9j/", "R0lGODlh", "PHN2Zy", "")) + some(alpha + "+/", int(rng.integers(60, 2000)))
            value, before, after = (
                (pick(("sha512-", "sha384-", "sha256-")) + some(alpha + "+/", pick((43, 64, 86))) + pick(("", "=", "==")), pick(("integrity ", '"integrity": "', "integrity=")), " "), (picture, f"{pick(parts)} data:{pick(('image/png', 'font/woff', 'image/jpeg'))};base64,", '"'),
                (camel + "".join(map(str.capitalize, name)), pick(parts) + pick((".", " ", " = ")), "("), (snake, f"{pick(parts)} {pick(('cache_key', 'sort_key', 'primary_key', 'keyboard', 'author', 'authority', 'token_type'))}{pick((' = ', ': ', '='))}" + '"', '"'),
                (pick(("password", "pass", "<password>", "${DB_PASS}", "$PASSWORD", "xxxx", "****", "{password}", "%(password)s", "yourpassword")), f"{pick(parts)} {pick(('postgres', 'https', 'mysql'))}://{pick(('user', 'username', 'root'))}:", "@" + pick(("localhost", "host", "example.com"))),
                (pick(("${DB_PASS}", "<password>", "required", "optional", "undefined")), f"{pick(parts)} {pick(('pw', 'pass'))}{pick((': ', '='))}", " "),
            )[int(rng.integers(0, 6))]
            rows.append((value, before, after, pick(("tests/data.py", "docs/readme.md", "", "src4", "src/settings.py")), 0))
    return pd.DataFrame(rows, columns=["value", "before", "after", "path", "label"])


def train(findings: DataFrame, lang: Language, *, limit: int = 20_000, **options) -> Forest:
    """Fits on at most ``limit`` labelled findings (value, before, after, path, label)."""
    rows = bounded_ids(findings.where("value IS NOT NULL AND label IS NOT NULL"), "value", limit, 2).toPandas()
    rows = rows.fillna({"before": "", "after": "", "path": ""}).sort_values(["value", "before", "after", "path", "label"])
    x = np.array([features(v, b, a, p, lang) for v, b, a, p in zip(rows["value"], rows["before"], rows["after"], rows["path"], strict=True)], float)
    return fit(x.reshape(-1, len(FEATURES)), rows["label"].to_numpy(float), **options)


def scan(docs: DataFrame, forest: Forest, lang: Language, *, threshold: float = 0.5) -> DataFrame:
    """Every candidate of ``docs(doc_id, text, path)`` with its score and whether it is reported (score >= ``threshold``).

    Null and empty texts have no candidates; a null path is an empty one; repeated rows report repeatedly. Very long texts are
    scanned whole; an empty table gives an empty result. The value is given as its offsets and a SHA-256, so that reports don't spread the secrets.
    """
    sent = docs.sparkSession.sparkContext.broadcast((forest, lang))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, lang = sent.value
        for pdf in batches:
            x = np.array([features(v, b, a, p, lang) for v, b, a, p in zip(pdf["value"], pdf["before"], pdf["after"], pdf["path"], strict=True)], float).reshape(-1, len(FEATURES))
            p = forest.score(x)
            yield pdf[["doc_id", "start", "end", "value"]].assign(score=p, reported=p >= threshold)

    found = map_with_ids(candidates(docs), run, "doc_id long, start long, end long, value string, score double, reported boolean", "doc_id")
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "reported")

"""Operator 8, secret scan: candidates by pattern, false positives removed by a random forest.

Everything that runs over documents is built from DataFrame functions. The forest is trained with
pyspark.ml on labelled findings and turned into CASE expressions.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from math import log2
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, unused

#: Characters of context to either side.
CONTEXT = 48
#: Candidates to either side that context may run over.
NEAR = CONTEXT // 6
#: What a secret becomes in a redacted text.
MASK = "[SECRET]"

# Words that tell secrets, words that tell other things, and stand-ins.
SECRET_WORDS = ("token", "secret", "passw", "passphrase", "pwd", "api_key", "apikey", "api-key", "access_key", "access-key", "private_key", "credential", "auth", "bearer")
OTHER_WORDS = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "revision", "uuid", "guid", "order", "invoice", "phone", "isbn", "version", "serial")
DUMMY_WORDS = ("example", "sample", "dummy", "test", "your", "xxxx", "placeholder", "changeme", "redacted", "foobar", "null", "none", "here")

# Parts of the pattern of candidates. The possessive loops keep it linear and off the stack.
_RUN, _EDGE = "[A-Za-z0-9_+/-]", "(?<![A-Za-z0-9_+/-])"
_KEY = "[A-Z ]{0,30}PRIVATE KEY(?: BLOCK)?-----"
_VALUE = "[^\\s\"'`,;.)\\]}>]"
_NAMED = r"(?<=[=: \t\"'`])(?<=[=:][ \t]?[\"'`]?)(?<=(?:%s)[A-Za-z0-9_-]{0,16}[\"'`]?[ \t]{0,2}[=:][ \t]?[\"'`]?)" % ("(?i:" + "|".join(map(re.escape, SECRET_WORDS)) + ")")
#: A candidate, by the first that fits: a private key from BEGIN to END (or the base64 lines that follow BEGIN);
#: a value of 6 or more characters other than blanks and quotes (unquoted, also up to a comma, semicolon or
#: angle bracket) that is assigned to a secret word; a key with a known head; a run of 8 or more key characters that holds a digit, and its padding unless that assigns a value.
CANDIDATE = "|".join((
    rf"-----BEGIN {_KEY}(?:(?:[^-]++|-(?!----))*+-----END {_KEY}|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{{24,}}+={{0,2}}+)*+)",
    rf"{_NAMED}(?!-----BEGIN )(?:(?<=[\"'`])[^\s\"'`]{{6,}}|(?<![\"'`])[^\s\"'`,;<>]{{5,}}{_VALUE})",
    rf"{_EDGE}(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}(?!{_RUN})|(?:gh[pousr]_|xox[abprs]-|AIza){_RUN}{{16,}}|sk-[A-Za-z0-9]{{20,}}(?!{_RUN})|(?=[A-Za-z_+/-]*[0-9]){_RUN}{{8,}}(?:==(?![=\"'`]?{_VALUE})|=(?!=|[ \t]*[\"'`]?{_VALUE}))?)",
))

FEATURES = ("length", "case_turns", "digit_turns", "digit_share", "upper_share", "distinct_share", "transitions", "dictionary", "glued", "hex", "uuid", "known_head", "slashes", "dashes", "secret_near", "other_near", "dummy", "assigned", "quoted", "assigns", "in_url", "path_test", "digits_only", "repeats", "marks", "code", "word")


def _any(words: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(map(re.escape, words))


@dataclass(frozen=True)
class Vocabulary:
    """Words of a public tokenizer's vocabulary, the commonest first, and how surprising (in bits) one
    lower-case letter is after another in them; both are of a fixed size, whatever the corpus."""

    words: tuple[str, ...]
    bits: tuple[float, ...]

    @classmethod
    def load(cls, path: str, size: int = 8000) -> Vocabulary:
        """``path``: a vocabulary whose tokens that end a word end in </w>."""
        with open(path, encoding="utf-8") as f:
            found = json.load(f)["model"]["vocab"]
        words = [t[:-4] for t in sorted(found, key=found.get) if re.fullmatch("[a-z]{3,}</w>", t)]
        seen = Counter(p for w in words for p in zip(w, w[1:]))
        first = Counter(a for w in words for a in w[:-1])
        bits = [round(log2((first[a] + 13) / (seen[a, b] + 0.5)), 3) for a in ascii_lowercase for b in ascii_lowercase]
        return cls(tuple(words[:size]), tuple(bits))


def features(c: Column, before: Column, after: Column, path: Column, vocabulary: Vocabulary) -> Column:
    """The forest's inputs for a candidate, its neighbouring text and the path of its document, as array<double>."""
    known = F.split(F.lit(" ".join(vocabulary.words)), " ")
    bits = F.from_json(F.lit(json.dumps(vocabulary.bits)), "array<double>")
    pairs = F.regexp_extract_all(F.lower(c), F.lit("(?=([a-z]{2}))"), F.lit(1))
    runs = F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))
    place = lambda x: (F.ascii(x) - 97) * 26 + F.ascii(F.substring(x, 2, 1)) - 97
    common = "|".join(w for w in vocabulary.words[:1000] if len(w) > 3)
    n = F.length(c)
    count = lambda pattern, x=c: F.regexp_count(x, F.lit(pattern))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    values = {
        "length": n,
        "case_turns": count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
        "digit_turns": count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])") / n,
        "digit_share": count("[0-9]") / n,
        "upper_share": count("[A-Z]") / n,
        "distinct_share": F.size(F.array_distinct(F.split(F.lower(c), ""))) / n,
        "transitions": F.aggregate(pairs, F.lit(0.0), lambda a, x: a + F.get(bits, place(x))) / F.greatest(F.size(pairs), F.lit(1)),
        "dictionary": F.aggregate(F.filter(runs, lambda w: F.array_contains(known, F.lower(w))), F.lit(0), lambda a, w: a + F.length(w)) / n,
        "glued": 1 - F.length(F.regexp_replace(F.lower(c), common, "")) / n,
        "hex": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "uuid": flag(c.rlike("(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")),
        "known_head": flag(c.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^sk-|^xox[abprs]-|^eyJ|^AIza|^-----BEGIN")),
        "slashes": count("/"),
        "dashes": count("[-_]"),
        "secret_near": flag(before.rlike(_any(SECRET_WORDS) + r"(?:[^\n]{0,24})$")),
        "other_near": flag(before.rlike(_any(OTHER_WORDS))),
        "dummy": flag(c.rlike(_any(DUMMY_WORDS))),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "assigns": flag(after.rlike(r"^[\"'`]?[ \t]*[=:]")),
        "in_url": flag(before.rlike(r"(?i)(?:https?:|www\.|[/.@#])[^\s\"'=]*$")),
        "path_test": flag(path.rlike("(?i)test|example|sample|mock|docs?/")),
        "digits_only": flag(c.rlike("^[0-9-]+$")),
        "repeats": count(r"(.)\1\1"),
        "marks": count(r"[^A-Za-z0-9_+/=\s-]") / n,
        "code": flag(c.rlike(r"^(?:\$[A-Za-z_{(]|[<{\[%]|[a-z+]+://)|\w[(\[]|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$")),
        "word": flag(c.rlike(r"^[A-Za-z]?[a-z]+[.,;:!?)]*$")),
    }
    return F.array(*[F.coalesce(values[k].cast("double"), F.lit(0.0)) for k in FEATURES])


def labelled_findings(spark: SparkSession, n: int = 8000, seed: int = 11) -> DataFrame:
    """before, candidate, after, path, label: n made-up findings of known kind, half of them secrets.

    Stands in for findings that people have labelled; replace it by those where there are some.
    """
    i = F.col("id")
    sha = F.sha2(F.concat_ws("-", i.cast("string"), F.lit(str(seed))), 256)
    pick = lambda k, m: F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(m))
    at = lambda k, words: F.get(F.array(*[w if isinstance(w, Column) else F.lit(w) for w in words]), pick(k, len(words)).cast("int"))
    b64 = F.regexp_replace(F.base64(F.unhex(sha)), "[=\r\n]", "")
    b32 = F.translate(F.upper(sha), "01894A2B", "GHJKLMNP")
    word = lambda k: at(k, ("report", "chapter", "summer", "window", "final-draft", "image", "blog-post", "section", "release", "backup"))
    prose = at(1, ("of the house and ", "les des que ", "und der nicht ", "for this that ", "see also ", "de la que "))
    name = at(2, ("token", "password", "secret", "api_key", "auth_token", "db_password", "SECRET_KEY", "access-key", "TOKEN"))
    glue = at(3, ("=", " = ", ": ", ":", '="', ' = "', "='"))
    cut = (F.lit(12) + pick(4, 29)).cast("int")
    anycase = F.when(pick(5, 4) == 0, F.upper(sha)).otherwise(sha)
    quoted = at(3, ('="', ' = "', "='", ': "'))
    syllable = lambda k: at(k, ("cor", "rect", "horse", "bat", "tery", "stap", "le", "mor", "van", "quil", "tig", "er", "pol", "ish", "gran", "ite"))
    mark = lambda k: at(k, ("!", "@", "&", "#", "%", "*", "?", "^", "~"))
    good = [
        (F.concat(prose, name, glue), F.substring(anycase, F.lit(1), cut)),
        (F.concat(prose, name, glue), F.substring(b64, F.lit(1), cut)),
        (F.concat(prose, name, glue), F.substring(anycase, 1, 40)),
        (prose, F.concat(F.lit("AKIA"), F.substring(b32, 1, 16))),
        (F.concat(prose, at(6, ("", "key: ", "export X="))), F.concat(at(7, ("ghp_", "gho_", "sk-", "xoxb-", "AIza")), F.substring(F.regexp_replace(b64, "[+/]", "x"), 1, 36))),
    ]
    good += [
        (F.concat(prose, name, quoted), F.concat_ws("-", *[F.concat(syllable(k), syllable(k + 1)) for k in (30, 32, 34, 36)])),
        (F.concat(prose, name, glue), F.concat(F.initcap(syllable(38)), pick(39, 10).cast("string"), mark(40), syllable(41), mark(42), F.substring(anycase, 1, 4), mark(43), pick(44, 90).cast("string"))),
        (F.concat(prose, name, glue), F.translate(F.substring(F.regexp_replace(b64, "[+/]", "x"), F.lit(1), cut), "0123456789", "qWkZvJxPbG")),
        (prose, F.concat(F.lit("-----BEGIN "), at(53, ("", "RSA ", "EC ", "OPENSSH ")), F.lit("PRIVATE KEY-----\n"), F.repeat(F.concat(at(54, (b64, b64, sha)), F.lit("\n")), pick(55, 40).cast("int")), at(56, ("", "-----END PRIVATE KEY-----")))),
    ]
    good += [
        (F.concat(prose, name, glue), F.concat(*[syllable(k) for k in range(63, 69)])),
        (F.concat(prose, name, glue), F.concat(syllable(69), syllable(70), F.when(pick(73, 2) == 0, syllable(71)).otherwise(""), pick(72, 90).cast("string"))),
    ]
    bad = [
        (prose, F.substring(F.regexp_replace(F.concat(sha, F.md5(sha)), "[a-f]", ""), F.lit(1), (F.lit(8) + pick(8, 9)).cast("int"))),
        (prose, F.concat_ws("-", F.substring(F.regexp_replace(sha, "[a-f]", "7"), 1, 3), F.substring(F.regexp_replace(sha, "[a-f]", "3"), 4, 4))),
        (F.concat(prose, at(6, ("commit ", "sha1:", "md5 ", "checksum: ", "sha256=", "revision "))), F.substring(sha, F.lit(1), F.get(F.array(F.lit(32), F.lit(40), F.lit(64)), pick(9, 3).cast("int")))),
        (F.concat(prose, at(6, ("", "id: ", "uuid=", '"'))), F.concat_ws("-", F.substring(sha, 1, 8), F.substring(sha, 9, 4), F.substring(sha, 13, 4), F.substring(sha, 17, 4), F.substring(sha, 21, 12))),
        (F.concat(prose, at(6, ("https://www.site.org/", "http://host/", "/usr/share/", "file: "))), F.concat_ws("/", word(10), (F.lit(1990) + pick(11, 40)).cast("string"), word(12))),
        (F.concat(prose, at(6, ("", "see ", "the "))), F.concat(word(10), F.lit("-"), word(12), pick(11, 40).cast("string"))),
        (F.concat(prose, name, glue), F.concat(at(10, ("your_token_here", "example", "xxxxxxxxxxxx", "changeme", "dummy-password-", "test_key_")), pick(11, 900).cast("string"))),
        (F.concat(prose, at(6, ("on ", "date: ", "="))), F.concat_ws("-", (F.lit(1990) + pick(11, 40)).cast("string"), F.lpad((pick(12, 12) + 1).cast("string"), 2, "0"), F.lpad((pick(13, 28) + 1).cast("string"), 2, "0"))),
        (F.concat(prose, at(6, ("mail ", "at ", ""))), F.concat(syllable(57), syllable(58), syllable(59), syllable(60), pick(11, 90).cast("string"))),
    ]

    bad += [
        (F.concat(prose, at(45, ("token", "password", "secret", "author", "Authors", "authority", "credentials", "tokens")), at(46, (": ", "=", ":", ' = "'))), F.concat(at(47, ("required", "undefined", "disabled", "Christopher", "something", "mandatory", "unbelievable", "translation", "Elizabeth", "generated")), at(48, ("", "", "ly", "s")))),
        (F.concat(prose, name, glue), F.concat(at(49, ("os.environ[", "getpass.getpass(", "request.form.", "${DB_", "$(cat_", "settings.", "<%=params.", "self.config.", "https://www.site.org/")), F.when(pick(74, 2) == 0, word(50)).otherwise(""), at(51, ("", "])", ")", "}")))),
    ]

    holder = F.concat_ws("_", name, pick(61, 90).cast("string"))  # the name of a variable, told by what follows
    bad += [(prose, holder), (F.concat(prose, F.lit("export ")), F.concat(holder, F.lit("_KEY")))]

    def choose(forms: list, part: int, k: int) -> Column:
        out = forms[0][part]
        for j, f in enumerate(forms[1:], 1):
            out = F.when(pick(k, len(forms)) == j, f[part]).otherwise(out)
        return out

    label = pick(20, 2)
    quote = F.when(F.expr("right(before, 1) in ('\"', '''')"), F.expr("right(before, 1)")).otherwise(F.lit(" "))
    df = spark.range(n).select("id", label.cast("double").alias("label"), F.when(label == 1, choose(good, 0, 21)).otherwise(choose(bad, 0, 21)).alias("before"), F.when(label == 1, choose(good, 1, 21)).otherwise(choose(bad, 1, 21)).alias("candidate"), at(22, ("src0", "src1/app.py", "docs/readme", "tests/unit.py", "wiki")).alias("path"))
    assigns = F.when(label == 0, F.col("candidate").startswith(F.concat(name, F.lit("_"))))
    return df.withColumn("after", F.when(assigns, at(62, (" = 'x", "=x", ": x"))).otherwise(F.concat(quote, F.lit(" and the")))).drop("id")


@dataclass(frozen=True)
class Forest:
    """A trained forest: its trees as Spark prints them, and the vocabulary behind its features."""

    trees: tuple[str, ...]
    vocabulary: Vocabulary

    def votes(self, f: Column) -> Column:
        """The share of trees that call the candidate with these features a secret."""
        return reduce(lambda a, b: a + b, [_tree(d, f) for d in self.trees]) / len(self.trees)


def train(findings: DataFrame, vocabulary: Vocabulary, trees: int = 24, depth: int = 9, seed: int = 42) -> Forest:
    """Fit a random forest on labelled findings: before, candidate, after, path, label."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    x = features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), vocabulary)
    # written, as the fit reads them once for each level of its trees
    rows = materialize(materialize(findings, "findings").select("label", x.alias("x")), "findings-features")
    rows = rows.select("label", array_to_vector("x").alias("features")).coalesce(1)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", maxMemoryInMB=64).fit(rows)
    forest = Forest(tuple(t.toDebugString for t in model.trees), vocabulary)
    release(findings.sparkSession)
    return forest


def _tree(dump: str, f: Column) -> Column:
    """CASE expressions for one tree as Spark prints it."""
    lines = [x.strip() for x in dump.splitlines()[1:] if x.strip()]

    def node(i: int) -> tuple[Column, int]:
        if lines[i].startswith("Predict"):
            return F.lit(float(lines[i].split(":")[1])), i + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i])
        yes, j = node(i + 1)
        no, k = node(j + 1)  # after the line with Else
        return F.when(F.get(f, F.lit(int(m[1]))) <= F.lit(float(m[2])), yes).otherwise(no), k

    return node(0)[0]


def scan(df: DataFrame, forest: Forest, text: str = "text", path: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """Add ``secrets``: array of (start, length, candidate, votes) of the candidates that at least
    ``threshold`` of the trees call secret, and ``redacted``: the text with those masked.

    start counts characters from 0. Null text: no secrets, null redacted. Text without secrets is
    returned as it is. A null or missing path counts as one that says nothing. Works within the
    row: no exchange, so neither a hot source nor repeated rows matter. Extra columns are kept;
    columns named secrets or redacted are replaced.
    """
    where = F.col(path) if path and path in df.columns else F.lit(None).cast("string")
    plain = df.drop("secrets", "redacted")
    names = {x: unused(df, f"__{x}") for x in ("m", "g", "v", "any", "e")}
    col = lambda x: F.col(names[x])
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    cut = plain.withColumn(names["m"], F.coalesce(found, F.array().cast("array<string>")))
    cut = cut.withColumn(names["g"], F.when(F.size(col("m")) > 0, F.split(text, CANDIDATE)).otherwise(F.array().cast("array<string>")))
    m, g = col("m"), col("g")

    near_left, near_right = (lambda x: F.right(x, F.lit(CONTEXT))), (lambda x: F.left(x, F.lit(CONTEXT)))
    place = lambda x, k: F.coalesce(F.get(x, k), F.lit(""))

    def around(c: Column, i: Column) -> Column:
        # context runs over neighbouring candidates; as these have 6 characters or more, NEAR of them reach
        # CONTEXT, and only that many characters of each are joined, however long texts and gaps are
        lefts = [near_left(place(x, i - k)) for k in range(NEAR, 0, -1) for x in (g, m)]
        before = F.concat(*lefts, near_left(F.get(g, i)))
        after = F.concat(near_right(F.get(g, i + 1)), *[near_right(place(x, i + k + d)) for k in range(1, NEAR + 1) for x, d in ((m, 0), (g, 1))])
        return F.struct(c.alias("c"), near_left(before).alias("before"), near_right(after).alias("after"))

    one = lambda x: F.struct(x["c"].alias("c"), features(x["c"], x["before"], x["after"], where, forest.vocabulary).alias("f"))
    votes = F.transform(F.transform(F.transform(m, around), one), lambda x: F.struct(x["c"].alias("c"), forest.votes(x["f"]).alias("v")))
    cut = cut.withColumn(names["v"], votes)
    is_secret = lambda x: x["v"] >= threshold
    cut = cut.withColumn(names["any"], F.exists(col("v"), is_secret))
    # what stands before each secret; secrets are few, so their positions are summed from the sizes each time
    sizes = F.when(col("any"), F.transform(m, lambda c, i: (F.length(F.get(g, i)) + F.length(c)).cast("long")))
    cut = cut.withColumn(names["e"], sizes)
    total = lambda n: F.aggregate(F.slice(col("e"), F.lit(1), n), F.lit(0).cast("long"), lambda a, x: a + x)
    hits = F.filter(F.transform(col("v"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda h: is_secret(h["x"]))
    all_ = F.transform(hits, lambda h: F.struct((total(h["i"] + 1) - F.length(h["x"]["c"])).alias("start"), F.length(h["x"]["c"]).cast("long").alias("length"), h["x"]["c"].alias("candidate"), h["x"]["v"].alias("votes")))
    none = F.array().cast("array<struct<start:bigint,length:bigint,candidate:string,votes:double>>")
    cut = cut.withColumn("secrets", F.when(col("any"), all_).otherwise(none))
    parts = F.transform(col("v"), lambda x, i: F.concat(F.get(g, i), F.when(is_secret(x), F.lit(MASK)).otherwise(x["c"])))
    cut = cut.withColumn("redacted", F.when(col("any"), F.concat(F.array_join(parts, ""), F.element_at(g, -1))).otherwise(F.col(text)))
    return cut.drop(*names.values())


def findings(df: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row for each secret: key, start, length, candidate, votes.

    Null and empty texts and an empty table give no rows; repeated rows give theirs each; other
    columns play no part, whatever their names.
    """
    # an inner explode would make Spark filter on the size of secrets below the scan, and so scan twice
    each = scan(df.select(key, text, *([path] if path and path in df.columns else [])), forest, text, path).select(key, F.explode_outer("secrets").alias("s"))
    return each.filter("s is not null").select(key, "s.*")

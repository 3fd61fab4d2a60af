"""Secret scans: candidates by pattern, false positives removed by a random forest.

Only DataFrame expressions and Spark's own forest are used on the main path. A
candidate is the value assigned to a name such as password or token, the password
of a URL, a private key block, a web token, a webhook address, or else a run of at
least 16 key-like characters. Its features are its length, its
character classes and the transitions between them, how well its letter pairs and a
dictionary of word parts cover it, the path it was found under, and the words beside
it. The forest is trained from labelled findings, which are generated by rule with
a fixed seed: keys, tokens and passwords as tools issue them, against long words,
numbers, digests, identifiers, paths, code and placeholders.

One pattern marks all candidates of a text in one pass, so that a text of any length, and a
candidate of any length, costs time in proportion.

Defined results: null and empty texts hold nothing; very long texts are scanned whole;
each place of a repeated candidate is its own finding; repeated rows and null ids each
give their findings; a null path counts as an empty one; an empty table gives an empty
result; other columns are not read. The control characters 1 and 2 count as blanks
(and become blanks in a text that is redacted).
"""

from __future__ import annotations

import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that secrets are assigned to; the forms of a candidate; placeholders; paths of test material.
NAMES = r"passw(?:or)?[dt]|passwd|passphrase|pwd|kennwort|contraseña|secret|token|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|auth|credential"
ASSIGNED = rf"""((?<![\w.\-])[\w.\-]*?(?i:{NAMES})[\w.\-]{{0,20}}["'`\])]?[ \t]{{0,3}}(?::=|=>|==?|:)[ \t]{{0,3}}["'`]?)((?<=["'`])[^\s"'`]{{6,}}|[^\s"'`<>,;]{{5,}}[^\s"'`<>,;.!?:)\]}}])"""
URL_LOGIN = r"""(://[^\s/:@"']{1,64}:)([^\s/@"']{3,64})(?=@)"""
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*(?:-[^-]+){0,6}-----END [A-Z ]{0,40}PRIVATE KEY-----"
WEB_TOKEN = r"eyJ[\w\-]{8,}\.[\w\-]{8,}(?:\.[\w\-]*)?"
WEBHOOK = r"https://hooks\.[\w.]{1,40}/services/[\w/\-]{16,}"
RUN = r"[A-Za-z0-9+/_\-]{16,}"
CANDIDATE = f"{ASSIGNED}|{URL_LOGIN}|({KEY_BLOCK}|{WEB_TOKEN}|{WEBHOOK}|{RUN})"
FOR_WORDS = r"token|secret|passw|pwd|kennwort|contraseña|api.?key|apikey|access.?key|auth|bearer|credential|private"
AGAINST_WORDS = r"commit|sha1|sha256|md5|digest|checksum|hash|uuid|guid|revision|example|sample|dummy|placeholder|order|card|isbn|href|src|import"
PLACEHOLDER = r"(?i)example|your|placeholder|change_?me|insert|replace|xxxx|\*\*\*|[<>{}()\[\]]|dummy|sample|redacted|environ|process\.|config\.|request|self\."
ISSUED = r"^(?:AKIA|ASIA|gh[opsu]_|xox[abprs]-|sk_live_|rk_live_|AIza|glpat-|npm_|eyJ|-----BEGIN |https://hooks)"
TEST_PATHS = r"test|mock|fixture|sample|example|doc"
#: Parts of common words, for dictionary coverage and letter pairs.
DICTIONARY = (
    "tion ment ness able ible ing the and for with that this from have was are not you ation ough ever over under "
    "her his one our out all any can had has him how its may new now old see two way who did get let say she too use "
    "der die das und ein ich nicht mit sich auf eine keit heit lich ung schaft ver ent ber zer gen ten sch che est "
    "que los las del una con por para como más esta entre ción ado ida mente eza dad los ndo les des est dans qui par pour sur pas avec "
    "eau eux ait ent elle tre ance ence oir age ique password secret token index value data name user file path list "
    "object string number system window button title page page content config public private class function return "
    "ed er re in on an at en nd ti es or te of is it al ar st to nt ha he se ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur"
).split()
#: Labelled findings made; trees and their depth; least probability of a finding.
FINDINGS, TREES, DEPTH, LEAST = 8000, 32, 9, 0.5
#: Bytes of findings that are broadcast when texts are redacted; beyond, the join is shuffled.
BROADCAST_BYTES = 32 << 20
#: Characters beside a candidate that its words are taken from; characters that ``distinct`` counts; length from which ``distinct`` is a share.
BESIDE, COUNTED, COUNTED_LENGTH = 80, "abcdefghijklmnopqrstuvwxyz0123456789+/_-.!@#$%&*=", 40
FEATURES = ["length", "digits", "upper", "symbols", "hex", "transitions", "classes", "distinct", "pairs", "coverage", "slashes", "test_path", "for_near", "against_near", "assigned", "login", "placeholder", "issued", "only_letters", "only_digits"]
START, STOP = "\x01", "\x02"


def letter_pairs() -> str:
    """A pattern of one letter that forms, with the next one, a pair that some dictionary word part holds."""
    seen: dict[str, set[str]] = {}
    for w in DICTIONARY:
        for a, b in zip(w, w[1:], strict=False):
            if a.isascii() and b.isascii():
                seen.setdefault(a, set()).add(b)
    return "|".join(f"{a}(?=[{''.join(sorted(bs))}])" for a, bs in sorted(seen.items()))


def word_parts() -> str:
    """A pattern of the dictionary's word parts, longest first, grouped by their first letter."""
    groups: dict[str, list[str]] = {}
    for w in sorted(set(DICTIONARY), key=lambda w: (-len(w), w)):
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in sorted(groups.items()))


def marked(text: Column) -> Column:
    """The pieces of ``text``: what is before the first candidate, then for each one itself, STOP, and what follows it."""
    plain = F.translate(text, START + STOP, "  ")
    return F.split(F.regexp_replace(plain, CANDIDATE, f"$1$3{START}$2$4$5{STOP}"), START)


def once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """``df`` with a column that filters above are not pushed through, so that it is computed once."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(id, text_hash, path, at, finding, before, after): every candidate, numbered in its text, with the words beside it, as far as the candidates next to it."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path")).filter(F.col("text").isNotNull())
    pieces = once(rows, marked(F.col("text")), "pieces").filter(F.size("pieces") > 1).select("id", "path", F.sha2("text", 256).alias("text_hash"), "pieces")

    def beside(at: Column) -> Column:
        own, last = F.get("pieces", at), F.translate(F.get("pieces", at - 1), STOP, "")
        return F.struct(
            (at - 1).cast("long").alias("at"),
            F.substring_index(own, STOP, 1).alias("finding"),
            F.lower(F.right(last, F.lit(BESIDE))).alias("near"),
            F.lower(F.substring(F.substring_index(own, STOP, -1), 1, BESIDE)).alias("rest"),
        )

    each = pieces.select("id", "path", "text_hash", F.inline(F.transform(F.sequence(F.lit(1), F.size("pieces") - 1), beside)))
    return each.select(
        "id", "path", "text_hash", "at", "finding",
        F.regexp_extract("near", r"(?:\S+\s+){0,3}\S*$", 0).alias("before"),
        F.regexp_extract("rest", r"^\S*\s*\S*", 0).alias("after"),
    )


def share(c: Column, pattern: str) -> Column:
    """The share of ``c`` that is left without what ``pattern`` finds."""
    return F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


def with_features(found: DataFrame) -> DataFrame:
    """``found`` with the FEATURES, each in time that grows with the candidate's length only."""
    c = F.col("finding")
    low = F.lower(c)
    n = F.length(c)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^0-9A-Za-z]", "-"), "[0-9]", "#"), "[A-Z]", "U"), "[a-z]", "l")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    one = lambda x: x.cast("double")
    total = lambda xs: sum(xs[1:], xs[0])
    values = {
        "length": one(n),
        "digits": share(c, "[^0-9]"),
        "upper": share(c, "[^A-Z]"),
        "symbols": share(c, "[A-Za-z0-9]"),
        "hex": one(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "transitions": (runs - 1) / (n - 1),
        "classes": total([one(c.rlike(p)) for p in ("[0-9]", "[A-Z]", "[a-z]", "[^0-9A-Za-z]")]),
        "distinct": total([one(F.contains(low, F.lit(x))) for x in COUNTED]) / F.least(n, F.lit(COUNTED_LENGTH)),
        "pairs": 1 - (F.length(F.regexp_replace(low, letter_pairs(), "")) - 1) / (n - 1),
        "coverage": 1 - share(low, word_parts()),
        "slashes": share(c, "[^/]"),
        "test_path": one(F.lower("path").rlike(TEST_PATHS)),
        "for_near": one(F.col("before").rlike(FOR_WORDS)),
        "against_near": one(F.concat_ws(" ", "before", "after").rlike(AGAINST_WORDS)),
        "assigned": one(F.col("before").rlike(r"[=:>]\s*[\"'`]?$")),
        "login": one(F.col("before").rlike(r"://\S*:$")),
        "placeholder": one(c.rlike(PLACEHOLDER)),
        "issued": one(c.rlike(ISSUED)),
        "only_letters": one(c.rlike("^[A-Za-z]+$")),
        "only_digits": one(c.rlike("^[0-9]+$")),
    }
    return found.select("*", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f) for f, v in values.items()])


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> list[tuple[int, str, str, int]]:
    """(id, text, path, label) made by rule: each text holds one candidate among words of invented prose."""
    rng = random.Random(seed)
    hexa, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    syllables = [w for w in DICTIONARY if w.isascii() and 1 < len(w) < 5]
    prose = lambda k: [("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))) for _ in range(k)]
    joined = lambda least, most=99: next(w for w in iter(lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1 + least // 4, 14))), "") if least <= len(w) <= most)
    names = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth_token", "client_secret", "private_key", "db_password", "passwort"]
    assign = lambda: rng.choice(["=", ": ", " = ", ":", " => "])

    def chosen_password() -> str:
        """As people choose them: a word with digits, symbols or look-alikes in it; or a short random one."""
        kind = rng.randrange(4)
        if kind == 0:
            return joined(4, 9) + run("0123456789", rng.randint(1, 4)) + rng.choice(["", "", "!", "#", "$"])
        if kind == 1:
            word = joined(5, 10).capitalize()
            return "".join({"a": "4", "e": "3", "i": "1", "o": "0", "s": "$"}.get(x, x) if rng.random() < 0.6 else x for x in word) + rng.choice("!?#&%*") + run("0123456789", rng.randint(1, 3))
        if kind == 2:
            return run(mixed + "!@#$%&*-_.", rng.randint(8, 16)) + run("0123456789", 1) + rng.choice(mixed)
        return rng.choice([run(hexa, rng.randint(10, 15)), run(mixed, rng.randint(8, 15)) + "7"])

    def secret() -> str:
        kind = rng.randrange(16)
        value = rng.choice([lambda: run(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64])), lambda: run(mixed, rng.randint(18, 48)), lambda: run(mixed + "+/", 40)])()
        if kind < 3:
            return rng.choice(["AKIA", "ASIA"]) + run(upper + "0189", 16)
        if kind == 3:
            return rng.choice(["ghp_", "gho_", "sk_live_", "AIza", "glpat-", "npm_"]) + run(mixed, 36)
        if kind == 4:
            return f"Bearer {value}"
        if kind == 5:
            return f"{rng.choice(['postgres', 'mysql', 'amqp', 'https', 'redis'])}://{joined(4, 8)}:{rng.choice([chosen_password, lambda: value])()}@{joined(5, 9)}:5432/{joined(4, 8)}".replace("/@", "@")
        if kind == 6:
            return "eyJ" + run(mixed, 17) + ".eyJ" + run(mixed + "-_", rng.randint(20, 80)) + "." + run(mixed + "-_", 43)
        if kind == 7:
            return f"https://hooks.{rng.choice(['slack.com', 'chat.net'])}/services/T{run(upper, 8)}/B{run(upper, 8)}/{run(mixed, 24)}"
        if kind == 8:
            name = rng.choice(["RSA ", "EC ", "", "OPENSSH "])
            return f"-----BEGIN {name}PRIVATE KEY-----\n" + "\n".join(run(mixed + "+/", 64) for _ in range(rng.randint(3, 12))) + f"\n-----END {name}PRIVATE KEY-----"
        q = rng.choice(["", '"', "'"])
        return rng.choice(names) + assign() + q + (chosen_password() if kind < 12 else value) + q

    def harmless() -> str:
        kind = rng.randrange(16)
        if kind < 4:
            return joined(16)
        if kind == 4:
            return run("0123456789", rng.choice([16, 16, 16, 17, 18, 20]))
        if kind == 5:
            return rng.choice(["commit ", "revision ", "sha1: ", "merge commit "]) + run(hexa, 40)
        if kind == 6:
            return rng.choice(["sha256:", "md5 ", "checksum ", "digest: ", "hash "]) + run(hexa, rng.choice([32, 64]))
        if kind == 7:
            return rng.choice(["uuid ", "", "request "]) + "-".join(run(hexa, k) for k in (8, 4, 4, 4, 12))
        if kind == 8:
            return "/".join(["", *prose(4), "index"]) + "/" + joined(6)
        if kind == 9:
            return rng.choice(names) + assign() + rng.choice(["your_api_key_here", "x" * 20, "EXAMPLE_TOKEN_VALUE", "replace_with_your_token", "<insert_token_here_now>", "changeme_changeme_now", "********", "your-password", "xxxxxxxx", "<password>", "[redacted]"])
        if kind == 10:
            return rng.choice(["-", "=", "_"]) * rng.randint(16, 60) if rng.random() < 0.5 else "_".join(prose(5))
        if kind == 11:
            return "".join(w.capitalize() for w in [*prose(5), "Handler"])
        if kind == 12:
            return rng.choice(names) + assign() + rng.choice(["get_%s()", "os.environ[%s]", "${%s}", "{{%s}}", "config.%s", "request.headers.%s", "self.%s", "process.env.%s", "load(%s)", "$%s", "args.%s", "new_%s"]) % joined(4, 9)
        if kind == 13:
            return rng.choice(names) + assign() + rng.choice(["string", "required", "optional", "undefined", "disabled", "invalid", "missing", "expired", "boolean", "Option<String>", "default", "password", joined(6, 12), joined(6, 12), joined(6, 12).capitalize()])
        if kind == 14:
            return f"{rng.choice(['postgres', 'https', 'mysql'])}://{rng.choice(['user', 'name', 'username'])}:{rng.choice(['password', 'pass', '<password>', '${PASSWORD}', '********', 'secret'])}@{joined(5, 9)}/{joined(4, 8)}"
        return "https://www." + joined(5, 10) + "/" + rng.choice(["-".join(prose(5)), "/".join(prose(4)) + "/" + "_".join(prose(2))])

    out = []
    for i in range(n):
        label = i % 2
        middle = secret() if label else harmless()
        text = " ".join([*prose(4), middle + rng.choice(["", "", ".", ",", "!!", "###", "$$$"]), *prose(3)])
        if rng.random() < 0.08 and "PRIVATE KEY" not in text and "eyJ" not in text and "hooks" not in text:
            text = text.upper()
        path = rng.choice(["src/app", "config/settings", "web", "src3"]) if label or rng.random() < 0.8 else rng.choice(["tests/fixtures", "docs/example"])
        out.append((i, text, path, label))
    return out


def train(spark: SparkSession) -> PipelineModel:
    """The forest fitted to the labelled findings."""
    labelled = spark.createDataFrame(labelled_findings(), "id long, text string, path string, label int")
    found = with_features(candidates(labelled, "id", "text", "path"))
    rows = found.join(labelled.select("id", "label"), "id").select("label", *FEATURES)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=4)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def find_secrets(docs: DataFrame, model: PipelineModel | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, text_hash, at, finding, probability): the candidates that the forest keeps; ``at`` is the candidate's number in its text, from 0."""
    model = model or train(docs.sparkSession)
    scored = model.transform(with_features(candidates(docs, id_col, text_col, path_col)))
    kept = scored.withColumn("p", F.element_at(vector_to_array("probability"), 2)).filter(F.col("p") >= least)
    return kept.select(F.col("id").alias(id_col), "text_hash", "at", "finding", F.col("p").alias("probability"))


def redact(docs: DataFrame, findings: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found secret replaced by ``mark`` in its place; texts without one are as they were."""
    key, found = "shoal_key", "shoal_found"
    while {key, found} & set(docs.columns):
        key, found = f"{key}_", f"{found}_"
    # equal texts have equal findings under one path, so the set of a key is bounded by one text
    by_text = findings.groupBy(F.col("text_hash").alias(key)).agg(F.collect_set("at").alias(found))
    size = by_text.agg(F.sum(F.size(found) * 8 + 100)).first()[0] or 0
    right = F.broadcast(by_text) if size <= BROADCAST_BYTES else by_text
    joined = docs.withColumn(key, F.sha2(text_col, 256)).join(right, key, "left")
    put = lambda p, i: F.when(F.array_contains(found, i.cast("long") - 1), F.concat(F.lit(mark), F.substring_index(p, STOP, -1))).otherwise(F.translate(p, STOP, ""))
    cleaned = F.when(F.col(found).isNotNull(), F.concat_ws("", F.transform(marked(F.col(text_col)), put)))
    return joined.select(*[F.coalesce(cleaned, F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in docs.columns])

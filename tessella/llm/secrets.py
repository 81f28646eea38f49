"""Secret scan: candidates by one pattern, false positives removed by a random forest compiled to SQL expressions.

A candidate is a run of 16 or more of A-Z a-z 0-9 + / _ - with what pads it; or whatever stands up to a blank, quote or
bracket, six characters at least, behind a secret's name and a sign of assignment; or the password of a URL with a user. A
'=' ends a name. A shorter run that no name announces, and a value of under six characters, is no candidate. The features
are length, transitions between kinds of characters and between consonants and vowels, how much of it common letter pairs and
dictionary words cover, the path of the file that it was found in (if a column is named), whether it is itself part of a path
or URL, and the words before and after it. The forest is trained on labelled findings: `labelled_findings` makes them by rule from templates
of real secrets and of look-alikes (commits, checksums, UUIDs, paths, card numbers, placeholders, long words, rules), a
fixed number of texts, cut into candidates as a scan cuts them. The fitted trees become arrays of nodes that an expression
walks, so that scanning is a projection without shuffle, join or Python.

Defined cases: null texts hold no candidates and stay null; empty texts stay empty. Every row is judged by itself, so
repeated rows, null ids and ties need no rule. Columns of any name pass through `redact` unchanged but for the text.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut

NAME = r"(?:token|secret|passw(?:or)?d|pwd|passphrase|api[_ -]?key|access[_ -]?key|private[_ -]?key|secret[_ -]?key|credentials?|authorization|auth)"
#: A value behind a name (short looks behind come first: long ones are slow at every blank); then a long run, padded unless the sign assigns.
ASSIGNED = rf"(?<=[=:\s\"'])(?:(?<=[=:]\s{{0,2}}[\"']?)(?<=(?i:{NAME}[\"']?\s?[=:]{{1,2}}\s{{0,2}}[\"']?))|(?<=[rR]\s)(?<=\b(?i:bearer)\s))(?!(?i:bearer|basic)\s)[^\s\"'`,;<>()\[\]{{}}=:][^\s\"'`,;<>()\[\]{{}}]{{5,}}+"
RUN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=\-]|[\"'][A-Za-z0-9+/_\-]))?+"
#: The password in scheme://user:password@host.
LOGIN = r"(?<=:)(?<=://[^\s:/@\"']{1,40}:)[^\s@/\"']{6,}+(?=@)"
CANDIDATE = f"{LOGIN}|{ASSIGNED}|{RUN}"
MASK = "[SECRET]"
AROUND = 40
N_FINDINGS = 3360
KINDS = 28
TREES, DEPTH, SEED = 25, 6, 42
THRESHOLD = 0.5

# Words of ordinary identifiers, slugs and placeholders, and the commonest English letter pairs.
DICTIONARY = (
    "about account after again archive article backup build chapter check client config data default demo dev document download draft example "
    "file final folder guide home image index info input install item list local login main manual message model module month news number object "
    "order output page part path photo picture post prod product profile public release report request response result review sample screenshot "
    "search section server service session setup shop site source start status story summer system table test text time title update upload user "
    "value version video view week winter world year your"
).split()
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()

FEATURES = ("length", "changes", "digits", "uppers", "distinct", "pairs", "words", "hex", "slashes", "repeats", "known", "named", "hashed", "sample", "assigned", "extension", "only_digits", "syllables", "clusters", "case_changes", "digit_changes", "in_path", "path_sample", "path_config")


def features(cand: Column, before: Column, after: Column, path: Column | None = None) -> dict[str, Column]:
    """The features of a candidate, in the order of FEATURES; path is that of its file."""
    path = F.lit("") if path is None else F.coalesce(path.cast("string"), F.lit(""))
    n = F.length(cand).cast("double")
    low = F.lower(cand)

    def share(pattern: str, of: Column = cand) -> Column:
        return (n - F.length(F.regexp_replace(of, pattern, ""))) / n

    def flag(c: Column) -> Column:
        return c.cast("double")

    return {
        "length": n,
        "changes": (F.regexp_count(cand, F.lit("(?<=[a-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[A-Z])[0-9]|(?<=[a-z])[A-Z]")) / n).cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / F.least(n, F.lit(36.0)),
        "pairs": share("|".join(PAIRS), low),
        "words": share("|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), low),
        "hex": flag(cand.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "slashes": (F.regexp_count(cand, F.lit("[/_-]")) / n).cast("double"),
        "repeats": flag(low.rlike(r"(.)\1{4}|0123456|1234567|abcdef")),
        "known": flag(cand.rlike("^(AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|sk-|xox[abp]-|AIza|eyJ|SG_|SG[.]|npm_|xox[a-z]-)")),
        "named": flag(before.rlike(rf"(?i)({NAME}|bearer)\W{{0,6}}$")),
        "hashed": flag(before.rlike(r"(?i)(commit|revision|rev|sha-?1|sha-?256|md5|checksum|digest|hash|etag|uuid|guid|build|request|trace|order|invoice|card|phone|id)\b[^.!?\n]{0,16}$")),
        "sample": flag(F.concat(before, low, after).rlike("(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx")),
        "assigned": flag(before.rlike(r"[=:]\s{0,2}[\"']?$")),
        "extension": flag(after.rlike(r"^\.[a-z]{2,4}\b")),
        "only_digits": flag(cand.rlike("^[0-9=+_-]+$")),
        "syllables": (F.regexp_count(low, F.lit("[bcdfghjklmnpqrstvwxz][aeiouy]")) / n).cast("double"),
        "clusters": (F.regexp_count(low, F.lit("[bcdfghjklmnpqrstvwxz]{4}")) / n).cast("double"),
        "case_changes": (F.regexp_count(cand, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / n).cast("double"),
        "digit_changes": (F.regexp_count(cand, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")) / n).cast("double"),
        "in_path": flag(before.rlike(r"(://|/)[^\s\"'=]*$") & ~before.rlike(r"://[^\s/@]*:$")),
        "path_sample": flag(path.rlike(r"(?i)\b(tests?|fixtures?|examples?|samples?|docs?|specs?|mocks?)\b")),
        "path_config": flag(path.rlike(r"(?i)\.(env|ya?ml|properties|ini|cfg|conf|pem)\b|\b(config|secrets?|credentials?|deploy)\b")),
    }


def labelled_findings(spark: SparkSession, n: int = N_FINDINGS) -> DataFrame:
    """(cand, before, after, path, label): the candidates of n texts made by rule; kinds alternate, every other text holds a secret.

    The texts are cut as `judged` cuts them; a candidate that the secret of its text reaches into is one.
    """
    base = spark.range(0, n, 1, 1).select("id", F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256).alias("h"), ((F.col("id") / 2).cast("long") % KINDS).cast("int").alias("kind"))
    base = base.withColumn("g", F.sha2(F.concat("h", F.lit("g")), 256))
    take = lambda xs, i, at: F.element_at(F.array(*map(F.lit, xs)), F.conv(F.substring("g", at, i), 16, 10).cast("int") % len(xs) + 1)
    words = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.element_at(F.array(*map(F.lit, DICTIONARY)), F.conv(F.substr("g", 1 + 4 * i, F.lit(4)), 16, 10).cast("int") % len(DICTIONARY) + 1))
    spoken = F.concat(*(take(PAIRS, 4, 25 + 4 * i) for i in range(4)))
    base = base.select("*", words.alias("w"), F.regexp_replace(F.base64(F.unhex("h")), "=", "").alias("b64"), F.base64(F.unhex("g")).alias("more"), F.translate("h", "abcdef", "123456").alias("figures"), F.translate(F.upper(F.substring("h", 1, 16)), "0123456789", "QWRTYUIOPS").alias("letters"), F.translate("g", "0123456789", "ghkmprtvxz").alias("small"), spoken.alias("spoken"))
    h, g, b64, figures, letters, small, spoken, word = F.col("h"), F.col("g"), F.col("b64"), F.col("figures"), F.col("letters"), F.col("small"), F.col("spoken"), [F.col("w")[i] for i in range(6)]
    yes = [
        ('token = "', F.substring(h, 1, 40), '" '), ('TOKEN = "', F.upper(F.substring(h, 1, 40)), '"!!'), ("api_key: ", F.substring(b64, 1, 32), " "), ("", F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), " "),
        ("secret='", F.substring(b64, 1, 40), "' "), ("Authorization: Bearer ", F.concat(F.lit("eyJ"), b64, F.substring("more", 1, 40)), " "), ("", F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), ", "), ("password=", F.substring(b64, 1, 20), "\n"),
        ("access key ", F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24)), " "), ('"private_key": "', F.concat(h, g), '" '), ('token = "', F.substring(h, 1, 40), '"### '), ("auth: ", F.substring(h, 1, 32), " "),
        ("key ", F.concat(F.lit("AKIA"), letters), " "), ("AWS_KEY=", F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))), "\n"), ("password: ", F.concat(word[2], F.substring(figures, 1, 1), F.substring(small, 1, 3)), " "),
        ("password: ", F.concat(F.substring(b64, 1, 9), F.lit("&"), F.substring(small, 1, 1), F.lit("4"), F.substring(small, 2, 2)), " "), ("DB_PASSWORD=", F.concat(word[2], F.substring(figures, 1, 1), F.initcap(word[3]), F.substring(figures, 2, 2)), "\n"),
        ("export API_KEY=", F.substring(b64, 1, 24), "\n"), ("pwd: ", F.concat(F.initcap(F.substring(small, 1, 5)), F.lit("!"), F.substring(figures, 1, 3)), "\n"), ('"secret": "', F.concat(F.substring(b64, 1, 12), F.lit("$"), F.substring(h, 1, 4)), '"}'),
        (F.concat(F.upper(F.concat_ws("_", *word[2:4])), F.element_at(F.array(*map(F.lit, ("_PASSWORD=", "_ADMIN_PASSWORD=", "_SECRET_ACCESS_KEY=", "_API_TOKEN="))), (F.conv(F.substring(g, 30, 2), 16, 10).cast("int") % 4 + 1))), F.substring(b64, 1, 20), "\n"),
        ("SLACK_BOT: ", F.concat(F.lit("xoxb-"), F.substring(figures, 1, 12), F.lit("-"), F.substring(figures, 13, 12), F.lit("-"), F.substring(b64, 1, 24)), " "), ("Cookie: session=", F.substring(h, 1, 32), "; "), ("maps key ", F.concat(F.lit("AIza"), F.substring(b64, 1, 35)), "\n"),
        ("//registry/:_authToken=", F.concat(F.lit("npm_"), F.substring(b64, 1, 36)), "\n"), (F.concat(F.lit("postgres://"), word[3], F.lit(":")), F.concat(word[2], F.substring(figures, 1, 3), F.lit("!"), F.substring(small, 1, 4)), "@db.host/app "), ("git ", F.concat(F.lit("glpat-"), F.substring(b64, 1, 20)), " "),
        ("SENDGRID=", F.concat(F.lit("SG."), F.substring(b64, 1, 22), F.lit("."), F.substring(b64, 23, 18)), "\n"),
    ]
    no = [
        ("commit ", F.substring(h, 1, 40), " "), ("sha256: ", h, " "), ('md5 = "', F.substring(h, 1, 32), '" '), ("id: ", F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), " "),
        ("card ", F.substring(figures, 1, 16), " "), ("https://news.site.example/", F.concat_ws("-", *word[:5], F.lit("2024")), ".html"), ("src=/static/", F.concat_ws("/", *word[:3], F.concat(word[3], F.substring(figures, 1, 4))), ".png"),
        ('token = "', F.lit("xxxxxxxx0000xxxxxxxxxxxx"), '" '), ("api_key: ", F.concat(F.lit("YOUR_API_KEY_EXAMPLE_"), F.substring(h, 1, 2), F.lit("0")), " "), ("the ", F.concat(*word[:3], F.substring(figures, 1, 2)), " of "),
        ("the ", F.concat(*word[:3]), " of "), ("see /", F.concat_ws("/", *word[:4]), "/ "), ("the ", F.concat_ws("-", *word[:4]), ", "), ("", F.repeat(F.element_at(F.array(*map(F.lit, "-_=/+")), (F.conv(F.substring(g, 30, 2), 16, 10).cast("int") % 5 + 1)), 30), "\n"),
        ("password: ", word[2], " is "), ("token: ", F.concat(word[2], F.lit("."), word[3]), " "), ("call ", F.concat(word[0], F.initcap(word[1]), F.initcap(word[2]), F.initcap(word[3])), "() "), ("api_key=", F.concat(F.lit("<your_"), word[2], F.lit(">")), " "), ("", F.upper(F.concat_ws("_", *word[2:5])), "=30\n"), ("token: ", spoken, " "),
        ("call ", F.concat(F.lit("+49-"), F.substring(figures, 1, 13)), " "), ("of the ", F.substring(figures, 1, 19), ", "),
        ("sha1 checksum token = ", F.substring(h, 1, 40), " "), ("etag: ", F.substring(h, 1, 32), " "), (F.concat(F.lit("https://cdn.site.example/"), word[0], F.lit("/")), F.concat(F.substring(h, 1, 20), F.lit("-"), word[1]), ".js"), ("import ", F.concat_ws("/", *word[:3], F.concat(F.initcap(word[3]), F.initcap(word[4]))), "\n"),
        ("build request ", F.substring(b64, 1, 22), " "), ("data:image/png;base64,iVBORw0KGgo", F.concat(b64, F.substring("more", 1, 40)), '" '),
    ]

    def rows(of: list) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.array(*(F.struct(text(a).alias("pre"), text(b).alias("value"), text(c).alias("post")) for a, b, c in of))

    base = base.withColumn("x", F.when(F.col("id") % 2 == 1, F.get(rows(yes), F.col("kind"))).otherwise(F.get(rows(no), F.col("kind")))).where("x is not null")
    places = F.array(*map(F.lit, ("", "web", "src/main.py", "notes.txt")))
    own = F.array(F.when(F.col("id") % 2 == 1, F.lit("deploy/app.env")).otherwise("tests/fixtures/data.json"))
    path = F.element_at(F.concat(places, own), F.conv(F.substring(g, 40, 2), 16, 10).cast("int") % 5 + 1)
    lead = F.concat(word[0], F.lit(" "), word[1], F.lit(" "))
    made = cut(base.select(F.concat(lead, "x.pre", "x.value", "x.post").alias("text"), F.col("x.value").alias("value"), path.alias("path"), (F.col("id") % 2).alias("secret")))
    found = made.where(F.col("text").rlike(CANDIDATE)).select("value", "secret", "path", F.explode(_split(F.col("text"), lambda c, before, after: F.struct(c.alias("cand"), before.alias("before"), after.alias("after")))[1]).alias("x"))
    reached = F.col("value").contains(F.col("x.cand")) | F.col("x.cand").contains(F.col("value"))
    return found.select("x.*", "path", ((F.col("secret") == 1) & reached).cast("double").alias("label"))


def _walk(node, names: tuple[str, ...]):
    """A fitted tree as nested tuples: (feature, limit, left, right), or the share of secrets in a leaf."""
    if node.subtreeDepth() == 0:
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)
    split = node.split()
    return names[split.featureIndex()], split.threshold(), _walk(node.leftChild(), names), _walk(node.rightChild(), names)


def train(spark: SparkSession, findings: DataFrame | None = None, trees: int = TREES, depth: int = DEPTH) -> list:
    """The fitted trees. findings: (cand, before, after, path, label), by default those of `labelled_findings`."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = (labelled_findings(spark) if findings is None else findings).select(F.col("label").cast("double").alias("label"), *(c.alias(k) for k, c in features(F.col("cand"), F.col("before"), F.col("after"), F.col("path")).items()))
    rows = cut(rows)  # so that the forest's passes read a plain table
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt").fit(ready)
    return [_walk(t._java_obj.rootNode(), FEATURES) for t in model.trees]


def forest(trees: list, path: Column | None = None) -> Callable[[Column, Column, Column], Column]:
    """The probability that (candidate, before, after), found in a file of that path, is a secret, as an expression."""

    roots, nodes = [], []  # (feature, limit, left, right, share of secrets); a leaf leads to itself

    def place(tree) -> int:
        at = len(nodes)
        nodes.append((0, 0.0, at, at, float(tree) if not isinstance(tree, tuple) else 0.0))
        if isinstance(tree, tuple):
            name, limit, left, right = tree
            nodes[at] = (FEATURES.index(name), float(limit), place(left), place(right), 0.0)
        return at

    def depth(tree) -> int:
        return 1 + max(depth(tree[2]), depth(tree[3])) if isinstance(tree, tuple) else 0

    roots = [place(t) for t in trees]
    literal = lambda xs, kind: F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")  # noqa: E731  folded to one literal
    feature, limit, left, right, share = (literal(xs, kind) for xs, kind in zip(zip(*nodes, strict=True), ("int", "double", "int", "int", "double"), strict=True))
    steps = F.sequence(F.lit(1), F.lit(max(1, max(map(depth, trees)))))

    def probability(cand: Column, before: Column, after: Column) -> Column:
        packed = F.array(*features(cand, before, after, path).values())

        def mean(f: Column) -> Column:
            walk = lambda root: F.aggregate(steps, root, lambda at, _: F.when(F.get(f, F.get(feature, at)) <= F.get(limit, at), F.get(left, at)).otherwise(F.get(right, at)))
            return F.aggregate(literal(roots, "int"), F.lit(0.0), lambda sum_, root: sum_ + F.get(share, walk(root))) / len(trees)

        return F.transform(F.array(packed), mean)[0]  # the features are computed once, the trees look at them

    return probability


def _split(text: Column, made: Callable[[Column, Column, Column], Column]) -> tuple[Column, Column]:
    """(pieces between the candidates, array of made(cand, before, after)); a candidate before is part of before."""
    found, pieces = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)

    def one(x: Column) -> Callable[[Column, Column], Column]:
        return lambda c, i: made(c, F.right(F.concat(F.coalesce(F.get(x["found"], i - 1), F.lit("")), x["pieces"][i]), F.lit(AROUND)), F.left(x["pieces"][i + 1], F.lit(AROUND)))

    return pieces, F.transform(F.array(F.struct(found.alias("found"), pieces.alias("pieces"))), lambda x: F.transform(x["found"], one(x)))[0]


def judged(text: Column, probability: Callable) -> tuple[Column, Column]:
    """(pieces between the candidates, array of (cand, probability)); for texts that hold candidates."""
    return _split(text, lambda c, before, after: F.struct(c.alias("cand"), probability(c, before, after).alias("probability")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", trees: list | None = None, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """(doc_id, finding_no, cand, probability, is_secret): a row for every candidate, numbered within its text from 1."""
    probability = forest(trees or train(docs.sparkSession), F.col("path"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), (F.lit("") if path is None else F.col(path)).alias("path")).where(F.col("text").rlike(CANDIDATE))
    found = rows.select("doc_id", F.posexplode(judged(F.col("text"), probability)[1]).alias("pos", "x"))
    return found.select("doc_id", (F.col("pos") + 1).alias("finding_no"), F.col("x.cand").alias("cand"), F.round("x.probability", 6).alias("probability"), (F.col("x.probability") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, text: str = "text", trees: list | None = None, threshold: float = THRESHOLD, path: str | None = None) -> DataFrame:
    """docs with every secret in the text replaced by MASK."""
    probability = forest(trees or train(docs.sparkSession), None if path is None else F.col(path))
    pieces, found = judged(F.col(text), probability)
    kept = F.concat(F.transform(found, lambda x: F.when(x["probability"] >= threshold, F.lit(MASK)).otherwise(x["cand"])), F.array(F.lit("")))
    return docs.withColumn(text, F.when(F.col(text).rlike(CANDIDATE), F.array_join(F.zip_with(pieces, kept, lambda a, b: F.concat(a, b)), "")).otherwise(F.col(text)))

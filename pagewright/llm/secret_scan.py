"""Secret scanning with a random forest that removes false positives, with DataFrame operations only.

Candidates are all long runs of key-like characters of a word, whole values after a telling key name (from 6 characters, with
other characters too), passwords of URLs, and the bodies of PEM private keys; the segments of a JWT are one run. The
forest judges each on its length, the transitions between classes of characters, the share of it that dictionary words
cover, the path it lies in (key name, URL, file name) and its neighbouring words. It is fitted on labelled findings: a
table (word, before, after, is_secret), by default a generated one of `FINDINGS` rows with keys of several makers
beside hashes, ids, numbers, names and placeholders.

All happens inside a document's row: candidates, features and the forest, whose nodes are arrays that a fold walks, are
higher-order functions, so nothing is shuffled and a finding needs no key to find its row again.

Defined cases: null and empty texts have no candidate; a null doc_id is scanned and redacted like any other; repeated
rows are scanned each. A run without a digit is judged only after a telling key name, as password of a URL, or if it
has 32 letters of both cases. Redaction replaces a secret wherever it stands in its row.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, unboxed, written

#: Rows of generated labelled findings.
FINDINGS = 8000
MASK = "[SECRET]"

# Words that tell of a secret, of something else, and words that names are made of.
TELLING = "passw(or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth(?!or(?!iz))|bearer"
HARMLESS = "commit|sha1|sha256|md5|hash|checksum|digest|uuid|guid|etag|revision|build|version|order|invoice|isbn|phone|tel|example|sample|dummy|placeholder|fixture"
DICTIONARY = "about|access|account|admin|after|array|backup|block|build|cache|change|check|class|client|cloud|code|config|content|count|create|data|date|default|demo|detail|device|document|download|dummy|email|entry|error|event|example|export|field|file|final|first|folder|format|frame|from|function|group|home|image|import|index|input|item|label|license|line|list|local|login|mail|main|manager|message|model|module|name|network|number|object|option|order|output|page|param|part|password|path|picture|place|print|product|project|public|query|record|release|report|request|result|sample|schema|screen|script|search|secret|section|server|service|session|setting|source|stage|start|state|status|string|style|summary|system|table|target|template|test|text|this|thumb|time|title|token|total|track|type|update|upload|user|value|version|video|view|widget|window|with|work"
PLACEHOLDER = r"example|xxxx|your|changeme|placeholder|dummy|12345678|(.)\1{5,}"
PREFIX = "^(AKIA|ASIA|AIza|ghp_|gho_|ghs_|glpat-|xox[abp]-|sk_live_|sk-|npm_|eyJ)"

#: A run of key-like characters; of a JWT all segments; after a telling name and = or : the whole value.
NAME = r"(?i:passw(?:or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)[A-Za-z_]{0,8}"
IN_VALUE = r"\x20\x09-\x0D\x22\x27,;&<>()\[\]{}\\"
RUN = rf"eyJ[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+|(?<={NAME}[\x22\x27\\]{{0,2}}[=:][\x22\x27\\]{{0,2}})[^{IN_VALUE}]{{5,}}[^.:{IN_VALUE}]|[A-Za-z0-9+/_\-]+"
PEM = r"(?s)-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----\s*(.+?)\s*-----END"


#: The words of a text that may hold a secret, of the array w of its words.
WORDS = """transform(filter(sequence(1, size(w)), i -> char_length(w[i - 1]) >= 6 and (w[i - 1] rlike r'[0-9=:]|[A-Za-z+/]{32}' or (i > 1 and right(w[i - 2], 1) in ('=', ':')))),
    i -> struct(i - 1 as at, w[i - 1] as word, concat_ws(' ', get(w, i - 3), get(w, i - 2)) as before, coalesce(get(w, i), '') as after))"""
#: Steps over an array of candidates: each is a `transform`, so that nothing is computed twice, wherever the optimizer puts the whole.
#: What a word is assigned to goes before it: `key = value` is `key=value`.
JOINED = r"""transform(COLUMN, s -> if(s.before rlike r'[=:]$', struct(s.at, concat(replace(s.before, ' ', ''), s.word) as word, '' as before, s.after), s))"""
RUNS = rf"""transform(COLUMN, s -> struct(s.at, s.before, s.after, regexp_extract_all(s.word, r'([^A-Za-z0-9+/_\-]*?)({RUN})', 1) as gaps,
    regexp_extract_all(s.word, r'([^A-Za-z0-9+/_\-]*?)({RUN})', 2) as runs, regexp_extract(s.word, r'[^A-Za-z0-9+/_\-]*$', 0) as tail))"""
EACH = """flatten(transform(COLUMN, s -> transform(filter(sequence(0, size(s.runs)), i -> char_length(get(s.runs, i)) >= 6), i -> struct(s.at, s.before, s.after,
    s.runs[i] as run, s.gaps[i] as gap, coalesce(get(s.gaps, i + 1), s.tail) as next_gap, i as place, i = size(s.runs) - 1 as is_last,
    concat(coalesce(get(s.gaps, i - 2), ''), coalesce(get(s.runs, i - 2), ''), coalesce(get(s.gaps, i - 1), ''), coalesce(get(s.runs, i - 1), '')) as ahead,
    coalesce(get(s.runs, i + 1), '') as behind))))"""
#: value with padding, the key name that it is assigned to, the words or runs around it, and `piece`, what lies between the word's separators around it.
PLACED = r"""transform(COLUMN, s -> struct(s.at, concat(s.run, if(s.next_gap rlike r'^={1,2}$' and not s.is_last, '', regexp_extract(s.next_gap, r'^(={1,2})(?:[^=]|$)', 1))) as value,
    if(s.gap rlike r'[=:][\x22\x27\[(\\]*$' and s.place > 0, regexp_extract(s.ahead, r'([^,;{}&?]*)$', 1), '') as key,
    if(s.place < 2, s.before, regexp_extract(s.ahead, r'^(.*)[,;{}&?]', 1)) as before, if(s.is_last, s.after, s.behind) as after,
    concat(regexp_extract(concat(s.ahead, s.gap), r'([^,;{}&?\x22\x27]*)$', 1), s.run, regexp_extract(s.next_gap, r'^([^,;{}&?\x22\x27]*)', 1), if(s.next_gap rlike r'[,;{}&?\x22\x27]', '', s.behind)) as piece,
    s.gap rlike ':$' and s.next_gap rlike '^@' as userinfo))"""
NEAR = r"""transform(COLUMN, s -> struct(s.at, s.value, s.key, s.after, s.piece, s.userinfo, lower(s.value) as low, lower(concat_ws(' ', s.before, s.key)) as near))"""
WORTH = rf"""filter(COLUMN, s -> s.userinfo or (s.key <> '' and s.near rlike r'{TELLING}') or (s.value rlike '[0-9]' and (char_length(s.value) >= 16 or (char_length(s.value) >= 8 and s.near rlike r'{TELLING}')))
    or (char_length(s.value) >= 32 and s.value rlike '[a-z]' and s.value rlike '[A-Z]'))"""
#: The same for the bodies of private keys, whose word number is null.
KEYS = rf"""transform(if(contains(COLUMN, 'PRIVATE KEY-----'), regexp_extract_all(COLUMN, r'{PEM}', 1), cast(array() as array<string>)),
    x -> struct(cast(null as int) as at, x as value, 'privatekey' as key, '' as after, x as piece, false as userinfo, lower(x) as low, 'private_key' as near))"""
SHAPED = r"""transform(COLUMN, s -> struct(s.*, cast(char_length(s.value) as double) as n,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(s.value, '[a-z]', 'a'), '[A-Z]', 'A'), '[0-9]', '0'), '[^aA0]', '_') as shape))""".replace("s.*", "s.at, s.value, s.key, s.after, s.piece, s.userinfo, s.low, s.near")

_share = "(char_length(s.shape) - char_length(replace(s.shape, '{}', ''))) / s.n".format
FEATURES = {
    "length": "s.n",
    "transitions": r"(char_length(regexp_replace(s.shape, r'(.)\1+', '$1')) - 1) / s.n",
    "digits": _share("0"),
    "uppers": _share("A"),
    "lowers": _share("a"),
    "others": _share("_"),
    "distinct": "size(array_distinct(split(s.value, ''))) / s.n",
    "longest_letters": "array_max(transform(split(s.value, '[^A-Za-z]+'), x -> char_length(x))) / s.n",
    "hexadecimal": "cast(s.low rlike '^[0-9a-f]+$' as double)",
    "dictionary": f"(s.n - char_length(regexp_replace(s.low, '{DICTIONARY}', ''))) / s.n",
    "known_prefix": f"cast(s.value rlike '{PREFIX}' as double)",
    "telling": f"cast(s.near rlike r'{TELLING}' as double)",
    "assigned": "cast(s.key <> '' as double)",
    "path": r"cast(s.piece rlike r'://|@|/[\w.-]+/|\.[a-z]{2,5}\b' as double)",
    "userinfo": "cast(s.userinfo as double)",
    "harmless_before": f"cast(s.near rlike '{HARMLESS}' as double)",
    "harmless_after": f"cast(lower(s.after) rlike '{HARMLESS}' as double)",
    "placeholder": rf"cast(s.low rlike r'{PLACEHOLDER}' as double)",
}


def _chain(found: str, *steps: str) -> str:
    """The expression of an array with the steps applied to it, one after the other."""
    for step in steps:
        found = step.replace("COLUMN", found)
    return found


def _measured(found: str) -> str:
    """An array of what NEAR gives as array<struct<at, value, f>>, f the features in order."""
    f = ", ".join(f"cast({x} as double)" for x in FEATURES.values())
    return f"transform({_chain(found, SHAPED)}, s -> struct(s.at, s.value, array({f}) as f))"


def candidates(text: str) -> str:
    """array<struct<at, value, f>> of a text's candidates: word number from 0, value, features. The text is read once, as t."""
    words = rf"flatten(transform(array(split(t, r'[\x20\x09-\x0D]+', -1)), w -> {WORDS}))"
    found = _chain(words, JOINED, RUNS, EACH, PLACED, NEAR, WORTH)
    both = f"concat({found}, {KEYS.replace('COLUMN', 't')})"
    return f"flatten(transform(array(coalesce({text}, '')), t -> {_measured(both)}))"


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """kind, word, before, after, secret, is_secret: generated findings of many kinds. secret: the run of the word that
    is the secret; where null, its longest."""
    i = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hex"), F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), "id"), 256))).alias("b64"), (F.xxhash64("id") % 7).alias("r"))
    i = i.select("*", F.regexp_replace("b64", "[^A-Za-z0-9]", "").alias("plain"), F.regexp_replace("hex", "[^0-9]", "").alias("number"), F.regexp_replace("b64", "[^A-Za-z]", "").alias("letters"), F.split(F.lit(DICTIONARY), r"\|").alias("names"))
    prose = "element_at(array('the quick', 'and then', 'of their', 'der neue', 'para el', 'une page', 'was found'), cast(pmod(r, 7) as int) + 1)"
    name = lambda x: f"element_at(names, cast(pmod(id * 13 + {x} * 17, size(names)) as int) + 1)"
    phrase = "concat_ws('', transform(array(0, 7, 13, 29), x -> initcap(element_at(names, cast(pmod(id * 31 + x * 17 + r * x, size(names)) as int) + 1))))"
    jwt, aws, ghp, short = "concat('eyJ', left(plain, 17), '.eyJ', left(hex, 30), '.', left(b64, 20), right(plain, 12))", "concat('AKIA', upper(left(plain, 16)))", "concat('ghp_', left(plain, 36))", "left(plain, 18)"
    human = f"concat(initcap({name(3)}), element_at(array('@', '#', '!', '$', '%', '-', ''), cast(pmod(r, 7) as int) + 1), left(number, 3), '!')"
    longest = "cast(null as string)"
    # kind, word, before, after, the run that is the secret
    secrets = [
        ("aws id", aws, prose, "''", longest), ("password hex", "concat('password=', left(hex, 18))", prose, prose, longest), ("token quoted", "concat('\"', left(hex, 40), '\"')", "'token ='", prose, longest),
        ("github", ghp, prose, prose, longest), ("api key", "concat('api_key=', left(plain, 32))", prose, prose, longest), ("secret key", "concat('\"', left(plain, 40), '\",')", "'secret_key:'", "''", longest),
        ("slack", "concat('xoxb-', left(hex, 12), '-', right(hex, 24))", prose, prose, longest), ("stripe", "concat('sk_live_', left(plain, 24))", prose, prose, longest),
        ("pwd", "concat('pwd:', left(plain, 14))", prose, prose, longest), ("token upper", "concat('TOKEN=', upper(left(hex, 40)))", prose, prose, longest),
        ("bare mixed", "left(b64, 40)", prose, prose, "left(b64, 40)"), ("bare letters", "left(concat(letters, reverse(letters)), 40)", prose, prose, "left(concat(letters, reverse(letters)), 40)"),
        ("phrase", f"concat('password=', {phrase})", prose, prose, phrase), ("phrase apart", phrase, "'password ='", prose, phrase), ("phrase json", f"concat('{{\"secret\":\"', {phrase}, '\"}}')", prose, prose, phrase),
        ("phrase lower", f"concat('password=', lower({phrase}))", prose, prose, f"lower({phrase})"), ("token letters", "concat('token=', left(letters, 24))", prose, prose, "left(letters, 24)"), ("key letters", "left(letters, 20)", "'api_key:'", prose, "left(letters, 20)"),
        ("json github", f"concat('{{\"a\":\"', {ghp}, '\",\"region\":\"eu-central-', left(number, 1), '\"}}')", "''", "''", ghp), ("json aws", f"concat('{{\"aws\":\"', {aws}, '\",\"zone\":\"us-east-1-zone-', left(number, 1), '\",\"count\":', left(number, 9), '}}')", prose, "''", aws),
        ("url user", f"concat('https://user:', {short}, '@db.internal:', left(number, 4), '/path-name')", prose, prose, short), ("url short", f"concat('postgres://admin:', left(plain, 9), '@host-', left(number, 2), '.example.org/data_', left(number, 4))", prose, prose, "left(plain, 9)"),
        ("settings", "concat('password=', left(hex, 18), ',host=db-server-', left(number, 2))", prose, prose, "left(hex, 18)"), ("settings pwd", f"concat('user=service-account-', left(number, 2), ';pwd=', {short})", prose, prose, short),
        ("query", "concat('mode=read-write-', left(number, 2), '&token=', left(hex, 32), '&page=', left(number, 9))", prose, prose, "left(hex, 32)"), ("jwt", jwt, prose, prose, jwt), ("token jwt", f"concat('token=', {jwt})", prose, prose, jwt),
        ("human", f"concat('password:', {human})", prose, prose, human), ("human apart", human, "'login pwd:'", prose, human), ("human short", "concat('pwd=', initcap(left(letters, 5)), left(number, 2))", prose, prose, "concat(initcap(left(letters, 5)), left(number, 2))"),
    ]
    others = [
        ("commit", "left(hex, 40)", "'at commit'", prose), ("sha256", "concat('sha256:', hex)", "'the digest'", prose), ("etag", "concat('\"', left(hex, 32), '\"')", "'etag:'", prose),
        ("uuid", "concat_ws('-', left(hex, 8), substr(hex, 9, 4), substr(hex, 13, 4), substr(hex, 17, 4), right(hex, 12))", prose, prose),
        ("digits", "concat(left(number, 16), '.')", prose, prose), ("page", "concat('https://example.org/', left(hex, 16), '/index.html')", prose, prose), ("page port", "concat('https://db.example.org:8443/', left(hex, 20), '/page?id=', left(hex, 18))", prose, prose),
        ("region", "concat('{\"region\":\"eu-central-', left(number, 1), '\",\"build\":\"', left(hex, 32), '\"}')", prose, "''"), ("host", "concat('host=db-server-', cast(id % 90 as string), ',commit=', left(hex, 40))", prose, prose),
        ("mail", "concat('user', left(number, 3), '@mail', left(number, 1), '.example.com')", prose, prose),
        ("file name", "concat('document_version_', cast(id % 90 as string), '_final_report')", prose, prose), ("placeholder", "element_at(array('api_key=YOUR_API_KEY_12345678', 'api_key=YOUR_KEY_HERE', 'token=your-token-goes-here', 'secret=ExampleSecretValue'), cast(pmod(id, 4) as int) + 1)", prose, "'example'"), ("placeholder short", "element_at(array('password=changeme', 'token=xxxxxxxx', 'secret=your_secret_here', 'pwd=example123'), cast(pmod(id, 4) as int) + 1)", prose, prose),
        ("thumbnail", "concat('thumbnail-image-', left(number, 4), 'x', right(number, 3))", prose, prose), ("count", "concat('token_count=', left(number, 9), '00000000')", prose, prose),
        ("password name", f"concat('password_', {name(1)}, '=', {name(2)}, '_', {name(3)}, '_', {name(4)})", prose, prose), ("token name", f"concat({name(1)}, '-', {name(2)}, '-', {name(3)})", "'token:'", prose),
        ("class name", f"concat(initcap({name(1)}), 'ing', {name(2)}, 's')", "'access_token ='", prose), ("auth call", f"concat('auth=', {name(1)}, '.', {name(2)}, {name(3)}, '.', {name(4)})", prose, prose),
        ("camel", f"concat(lower({name(1)}), initcap({name(2)}), initcap({name(3)}), initcap({name(4)}), initcap({name(5)}), initcap({name(6)}), 'Of', initcap({name(7)}))", prose, prose), ("secret word", f"{name(4)}", "'the secret:'", prose),
    ]
    kinds = [(*x, 1.0) for x in secrets] + [(*x, "''", 0.0) for x in others]
    chosen = None
    for k, (kind, word, before, after, secret, label) in enumerate(kinds):
        row = F.struct(F.lit(kind).alias("kind"), F.expr(word).alias("word"), F.expr(before).alias("before"), F.expr(after).alias("after"), F.expr(secret).alias("secret"), F.lit(label).alias("is_secret"))
        chosen = F.when(F.col("id") % len(kinds) == k, row) if chosen is None else chosen.when(F.col("id") % len(kinds) == k, row)
    return i.select(chosen.alias("s")).select("s.*")


def labelled_rows(findings: DataFrame) -> DataFrame:
    """value, f (the features) and is_secret of every run of the findings that is to be judged, beside their other columns."""
    given = F.col("secret") if "secret" in findings.columns else F.lit(None).cast("string")
    longest = F.expr(r"array_max(transform(regexp_extract_all(word, r'([A-Za-z0-9+/_\-]+)', 1), x -> struct(char_length(x) as n, x as x))).x")
    one = "array(struct(cast(0 as int) as at, word, coalesce(before, '') as before, coalesce(after, '') as after))"
    made = findings.select("*", F.coalesce(given, longest).alias("_pw_meant"), F.expr(_measured(_chain(one, JOINED, RUNS, EACH, PLACED, NEAR, WORTH))).alias("_pw_found"))
    rest = [c for c in findings.columns if c not in ("is_secret", "secret")]
    runs = made.select(*rest, "is_secret", "_pw_meant", F.explode("_pw_found").alias("s"))
    meant = F.startswith("s.value", F.col("_pw_meant")) & (F.col("_pw_meant") != "")
    return runs.select(*rest, "s.value", "s.f", F.when(meant, F.col("is_secret")).otherwise(0.0).alias("is_secret"))


def train(findings: DataFrame, trees: int = 24, depth: int = 8) -> RandomForestClassificationModel:
    """findings: word, before, after, is_secret; and secret where a word has several runs, otherwise the longest is meant."""
    names = list(FEATURES)
    # Written first: the fit plans its rows again and again, and the driver would hold the findings' long expressions each time.
    rows = written(labelled_rows(findings).select("is_secret", *[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)]).coalesce(1), "findings")
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "is_secret").coalesce(1)
    return RandomForestClassifier(featuresCol="features", labelCol="is_secret", numTrees=trees, maxDepth=depth, seed=7, subsamplingRate=0.8).fit(rows)


def _numbers(values: list, kind: str) -> str:
    """An array that the optimizer makes a constant."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


class Forest(NamedTuple):
    """The nodes of a forest as arrays: of a leaf left and right are -1, value is the share of secrets in it."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]
    roots: list[int]
    depth: int


def nodes_of(model: RandomForestClassificationModel) -> Forest:
    feature, threshold, left, right, value, roots, depth = [], [], [], [], [], [], 1

    def add(node) -> int:
        at = len(feature)
        for column, x in ((feature, 0), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            column.append(x)
        if node.numDescendants() == 0:
            stats = list(node.impurityStats().stats())
            value[at] = stats[1] / sum(stats)
            return at
        feature[at], threshold[at] = node.split().featureIndex(), node.split().threshold()
        left[at] = add(node.leftChild())
        right[at] = add(node.rightChild())
        return at

    for tree in model.trees:
        roots.append(add(tree._java_obj.rootNode()))
        depth = max(depth, tree.depth)
    return Forest(feature, threshold, left, right, value, roots, depth)


@lru_cache(maxsize=2)
def _default(application: str) -> Forest:
    """The forest of the generated findings, fitted once an application: it doesn't depend on what is scanned. The arrays
    only, as a model's training summary holds the plan of its rows in the driver for as long as the model lives."""
    return nodes_of(train(labelled_findings(SparkSession.active())))


def default_model(spark: SparkSession) -> Forest:
    return _default(spark.sparkContext.applicationId)


def probability(model: RandomForestClassificationModel | Forest, f: str) -> str:
    """The forest as an expression of the feature array f: the mean over the trees of the share of secrets in the leaf."""
    x = model if isinstance(model, Forest) else nodes_of(model)
    step = f"if(get({_numbers(x.left, 'int')}, a) < 0, a, if(get({f}, get({_numbers(x.feature, 'int')}, a)) <= get({_numbers(x.threshold, 'double')}, a), get({_numbers(x.left, 'int')}, a), get({_numbers(x.right, 'int')}, a)))"
    leaf = f"aggregate({_numbers(list(range(x.depth)), 'int')}, r, (a, _) -> {step})"
    return f"aggregate({_numbers(x.roots, 'int')}, cast(0 as double), (p, r) -> p + get({_numbers(x.value, 'double')}, {leaf})) / {len(x.roots)}"


def findings(text: str, model: RandomForestClassificationModel | Forest, threshold: float = 0.5) -> Column:
    """array<struct<at, value, probability, is_secret>> of the text's candidates, of the name of its column."""
    scored = f"transform({candidates(text)}, s -> struct(s.at, s.value, {probability(model, 's.f')} as probability))"
    return F.expr(f"transform({scored}, s -> struct(s.at, s.value, s.probability, s.probability >= {threshold} as is_secret))")


def judged(docs: DataFrame, model: RandomForestClassificationModel | Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, at, value, probability, is_secret of every candidate; at is null for the body of a private key."""
    model = model or default_model(docs.sparkSession)
    # An outer explode: of another the optimizer would put a filter, with a second copy of the whole, before it.
    found = docs.select("doc_id", F.explode_outer(findings("text", model, threshold)).alias("s"))
    return found.where("s.value is not null").select("doc_id", "s.at", "s.value", "s.probability", "s.is_secret")


def scan_report(docs: DataFrame) -> DataFrame:
    """Findings without the secret itself: its length, a digest and the forest's verdict."""
    return judged(docs).select("doc_id", "at", F.char_length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), F.round("probability", 6).alias("probability"), "is_secret")


def redact(docs: DataFrame, model: RandomForestClassificationModel | Forest | None = None) -> DataFrame:
    """docs with MASK in place of every secret; every row stays."""
    found = boxed(docs).select("row", findings("row.text", model or default_model(docs.sparkSession)).alias("found"))
    # Longest first, so that no secret is cut by another that it holds.
    secrets = "array_distinct(transform(filter(found, s -> s.is_secret), s -> s.value))"
    order = "(a, b) -> case when char_length(a) <> char_length(b) then char_length(b) - char_length(a) when a < b then -1 when a > b then 1 else 0 end"
    masked = found.select("row", F.expr(f"aggregate(array_sort({secrets}, {order}), row.text, (t, v) -> replace(t, v, '{MASK}'))").alias("text"))
    changes = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col("text") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.char_length("text").cast("long"))
    return unboxed(masked, docs.columns, **changes)

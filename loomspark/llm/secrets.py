"""Secret scanning: candidates by one pattern, false positives removed by a random forest, all in SQL expressions.

A candidate is a private-key block, a value that is assigned to a name like password or token, or a run of 16
or more signs with a digit, as keys have. The text between candidates gives each one's neighbours. A candidate's
features are its length, its transitions between character classes and between vowels and consonants, how much of
it dictionary words cover, the shape of its signs, whether it stands in a path, address or link, and the words next to
it. A forest of decision trees, trained from labelled findings, gives the share of trees' votes that
it is a secret.

The default labelled findings are made by rule from hashes (labelled_findings, FINDINGS rows); train() takes any
others. Training looks at this bounded table only, on the driver; the trees become CASE expressions, so that scanning
is a projection of the documents: no shuffle, no Python, and a lost task is simply run again.

Defined results: null and empty texts have no candidates and stay as they are; repeated rows are scanned each; the
whole text is scanned, whatever its length: the pattern repeats groups possessively only, so that it neither recurses nor
goes over a sign again, and offsets are summed up in blocks, so that the work is linear in candidates. A score of exactly
THRESHOLD is a secret; there are no other ties. Offsets and lengths count code points. Other columns do not matter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = 4000
TREES, DEPTH, LEAST_LEAF = 25, 9, 4
THRESHOLD = 0.5
CONTEXT = 60
MARK = "[SECRET]"

_NAMES = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth[_-]?key|credentials?|client[_-]?secret|bearer)"
_ASSIGN = rf"(?i:{_NAMES})[\"'\]]{{0,2}}\s{{0,2}}(?:=>|:=|[:=])\s{{0,2}}[\"']?"
_RUN = r"A-Za-z0-9_+/~-"
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=\s:,]++|-(?!----))*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
    rf"|{_ASSIGN}[^\s\"'<>,;]{{6,}}"
    rf"|(?<![{_RUN}])(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![{_RUN}])|gh[pousr]_[A-Za-z0-9]{{30,}}+|[sr]k_live_[A-Za-z0-9]{{16,}}+)"
    rf"|(?<![{_RUN}])(?=[A-Za-z_+/~-]*+[0-9])(?:[A-Za-z0-9_+/~-]{{16,}}+|eyJ[A-Za-z0-9_-]{{8,}}+)(?:\.[A-Za-z0-9_-]{{16,}}+)*+={{0,2}}"
)
_KEY_WORDS = rf"(?i)\b{_NAMES}\b|\b(?:key|keys|aws|auth|login|export|credential|config|env)\b"
_OTHER_WORDS = r"(?i)\b(?:commit|sha|sha1|sha256|md5|checksum|digest|hash|uuid|guid|etag|revision|rev|order|invoice|card|visa|phone|tel|fax|isbn|iban|account|tracking|serial|version|release|build|image|png|jpg|base64|integrity|example|sample|dummy|test|blob|tree|parent)\b"
#: Dictionary for the coverage feature (fixed values).
WORDS = (
    "access account action address admin after again apple array async auth base before begin block blue bool build button cache call change changeme check child class clear client close code color column come "
    "common component config connect content context control copy count create current custom data date debug default delete dest detail device dir display document domain down element enable enter error event example "
    "expected export factory false field file filter final find first float folder follow form format from function general get global good great green group guest handler have header hello here home house http image "
    "import index info init input insert int integer item key label large last left level library light limit line link list load local login long main make manager master member menu message method model module more "
    "most mouse name need network never new next node none normal note null number object offset only open option order other output package page param parent parse part pass password path photo placeholder player please "
    "point port post prefix price print private process product profile project public query question read real record red reference remove report request require required reset response result return right root route "
    "row run sample save schema screen script search second secret section select send server service session set setting short show side simple single size source space start state static status step stop store string "
    "style submit summary sunshine super switch system table target task template test text that the then this time title token top total tree true type under undefined union unit update upload user utils value variable version video "
    "view visible void wait watch water width window with word work world write xxxx your"
).split()

#: Feature -> SQL over a struct c with value, named, before and after. v is the value.
FEATURES = {
    "length": "length({v})",
    "digits": "regexp_count({v}, '[0-9]') / greatest(1, length({v}))",
    "uppers": "regexp_count({v}, '[A-Z]') / greatest(1, length({v}))",
    "signs": "regexp_count({v}, '[^A-Za-z0-9]') / greatest(1, length({v}))",
    "classes": "regexp_count({v}, '(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])') / greatest(1, length({v}))",
    "syllables": "regexp_count(lower({v}), '(?<=[b-df-hj-np-tv-z])[aeiou](?![0-9])') / greatest(1, length({v}))",
    "doubles": "regexp_count({v}, '(.)\\\\1') / greatest(1, length({v}))",
    "distinct": "aggregate(sequence(33, 126), 0, (n, k) -> n + int(contains({v}, char(k)))) / greatest(1, least(94, length({v})))",
    "words": "1 - length(regexp_replace(lower({v}), '" + "|".join(sorted(WORDS, key=len, reverse=True)) + "', '')) / greatest(1, length({v}))",
    "hex": "int({v} rlike '^(?:[0-9a-f]+|[0-9A-F]+)$')",
    "numeric": "int({v} rlike '^[0-9+_-]+$')",
    "uuid": "int({v} rlike '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$')",
    "known": "int({v} rlike '^(?:AKIA|ASIA)[0-9A-Z]{{16}}$|^gh[pousr]_[A-Za-z0-9]{{30,}}|^github_pat_|^glpat-|^[sr]k_live_|^xox[abprs]-|^AIza[0-9A-Za-z_-]{{35}}|^eyJ[A-Za-z0-9_-]+[.]eyJ|^npm_|^-----BEGIN ')",
    "filler": "int({v} rlike '(?i)x{{4,}}|[*]{{3,}}|0{{6,}}|1234567|abcdefg|example|changeme|your|placeholder|dummy|sample|redacted|null|undefined|^<|^[$%{{]')",
    "slashes": "regexp_count({v}, '/') / greatest(1, length({v}))",
    "in_path": "int(c.before rlike '[/@.\\\\\\\\]$' or c.after rlike '^[@/\\\\\\\\]|^[.][a-z]{{2,5}}\\\\b' or c.before rlike '(?i)(?:https?|ftp|file):[^ ]*$')",
    "named": "int(c.named)",
    "near_key": "int(right(c.before, 40) rlike '{key}')",
    "near_other": "int(right(c.before, 40) rlike '{other}' or left(c.after, 20) rlike '{other}')",
    "quoted": "int(right(c.before, 1) rlike '[\"'']' or left(c.after, 1) rlike '[\"'']')",
}


def _sql(text: str) -> str:
    """A pattern as it stands in a SQL literal."""
    return text.replace("\\", "\\\\").replace("'", "\\'")


def _feature_sql() -> str:
    parts = [f"cast({sql.format(v='c.value', key=_sql(_KEY_WORDS), other=_sql(_OTHER_WORDS))} as double) as {name}" for name, sql in FEATURES.items()]
    return f"transform(found, c -> struct({', '.join(parts)}))"


def find_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds rest, the parts of the text between candidates, and found, an array of candidates in order.

    A candidate has raw, value (raw without an assignment's name), start and size of the value, named, before and after.
    """
    raw = F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0))
    df = df.withColumn("raw", F.coalesce(raw, F.array().cast("array<string>")))
    df = df.withColumn("rest", F.when(F.size("raw") > 0, F.split(F.col(text), CANDIDATE)).otherwise(F.array(F.col(text))))
    assign = _sql(rf"^{_ASSIGN}")
    value = f"regexp_replace(r, '{assign}', '')"
    candidate = f"""
        transform(raw, (r, i) -> named_struct('raw', r, 'value', {value}, 'named', r rlike '{assign}',
          'before', concat(right(rest[i], {CONTEXT}), left(r, length(r) - length({value}))),
          'after', left(rest[i + 1], {CONTEXT}), 'gap', length(rest[i]) + length(r)))"""
    df = df.withColumn("found", F.expr(candidate))
    return df.drop("raw").withColumn("ends", F.when(F.size("found") > 0, F.expr(_running("transform(found, c -> cast(c.gap as bigint))"))))


def _running(values: str, block: int = 256) -> str:
    """The running sums of an array. An array grows by copying, so sums run within blocks, and then over the blocks."""
    add = "concat(s, array(element_at(s, -1) + x))"
    sums = f"slice(aggregate(b, array(0L), (s, x) -> {add}), 2, size(b))"
    blocks = f"transform(sequence(0, (size(v) - 1) div {block}), k -> slice(v, int(k) * {block} + 1, {block}))"
    inner = f"transform({blocks}, b -> {sums})"
    begin = f"aggregate(inner, array(0L), (s, b) -> concat(s, array(element_at(s, -1) + element_at(b, -1))))"
    whole = f"transform(array(named_struct('inner', inner, 'begin', {begin})), w -> flatten(transform(w.inner, (b, i) -> transform(b, x -> x + w.begin[i]))))[0]"
    # Each name is bound by a transform over one element, so that nothing is computed again for every block.
    return f"transform(array({values}), v -> transform(array({inner}), inner -> {whole})[0])[0]"


# --- the labelled findings -------------------------------------------------------------------------------------

_NEUTRAL = "the and of winter river said stone paper about under market green walk table music seven little garden".split()
_FILLERS = ("changeme", "your_token_here", "xxxxxxxxxxxx", "********", "placeholder", "example123", "<password>", "${SECRET}", "password1234567", "000000000000", "REDACTED", "undefined")


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """label (1 for a secret) and text, a snippet with one finding; made by rule, the same in every run."""
    hexes = lambda n, salt="a": f"left(sha2(concat('{salt}', id), 512), {n})"
    mixed = lambda n, salt="m": f"left(translate(base64(unhex(sha2(concat('{salt}', id), 512))), '+/=', 'xQ7'), {n})"
    base64 = lambda n, salt="b": f"left(translate(base64(unhex(sha2(concat('{salt}', id), 512))), '=', 'A'), {n})"
    upper = lambda n, salt="u": f"left(upper(translate(base64(unhex(sha2(concat('{salt}', id), 512))), '+/=', '274')), {n})"
    digits = lambda n, salt="d": f"left(regexp_replace(sha2(concat('{salt}', id), 512), '[a-f]', ''), {n})"
    # A list is one literal, split at a sign that none of its items has.
    word = lambda salt, of=tuple(_NEUTRAL): f"element_at(split('{'~'.join(of)}', '~'), cast(1 + pmod(xxhash64(concat('{salt}', id)), {len(of)}) as int))"
    common = lambda salt: word(salt, tuple(w for w in WORDS if 4 <= len(w) <= 7))
    size = lambda low, high: f"cast({low} + pmod(xxhash64(concat('size', id)), {high - low + 1}) as int)"
    name = word("name", ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "pwd", "auth_key"))
    sign = word("sign", ("=", " = ", ": ", ":", " := "))
    quote = word("quote", ("", "", '"'))
    lead = f"concat({word('l1')}, ' ', {word('l2')}, ' ')"
    key_lead = word("kl", ("aws key ", "export AWS_KEY=", "login key: ", "auth: ", "config key ", "credential ", "the api key is "))
    other = lambda *of: word("other", of)
    secret = [
        f"concat({lead}, 'AKIA', {upper(16)})",
        f"concat({key_lead}, 'AKIA', {upper(16)})",
        f"concat({lead}, {name}, {sign}, {quote}, {hexes(size(12, 24))}, {quote})",
        f"concat({lead}, {name}, {sign}, {quote}, {hexes(size(32, 40))}, {quote})",
        f"concat({lead}, {name}, {sign}, {quote}, {mixed(size(10, 40))}, {quote})",
        f"concat({lead}, {name}, {sign}, {quote}, {mixed(size(5, 8))}, '!', {mixed(size(4, 7), 'n')}, '#', {quote})",
        f"concat({lead}, 'ghp_', {mixed(36)})",
        f"concat({lead}, 'sk_live_', {mixed(size(24, 32))})",
        f"concat({lead}, 'xoxb-', {digits(11)}, '-', {mixed(24)})",
        f"concat({lead}, 'AIza', {mixed(35)})",
        f"concat({lead}, 'eyJ', {mixed(30)}, '.eyJ', {mixed(50, 'j')}, '.', {mixed(43, 'k')})",
        f"concat({key_lead}, {base64(40)})",
        f"concat({key_lead}, {mixed(size(24, 44))})",
        f"concat({lead}, {mixed(size(36, 48))})",
        "concat('-----BEGIN RSA PRIVATE KEY-----\\n', base64(unhex(sha2(string(id), 512))), '\\n-----END RSA PRIVATE KEY-----')",
    ]
    harmless = [
        f"concat({other('id ', 'uuid ', 'request ', 'the ')}, {hexes(8)}, '-', {hexes(4, 'e')}, '-', {hexes(4, 'f')}, '-', {hexes(4, 'g')}, '-', {hexes(12, 'h')})",
        f"concat({other('commit ', 'sha1 ', 'revision ', 'parent ', 'tree ')}, {hexes(40)})",
        f"concat({other('md5 ', 'checksum: ', 'sha256 ', 'digest ')}, {hexes('cast(32 + 32 * pmod(id, 2) as int)')})",
        f"concat({lead}, {hexes(size(20, 40))}, ' ', {word('r')})",
        f"concat({other('card ', 'visa ', 'the ', 'and ', 'account ')}, '4', {digits(15)})",
        f"concat({lead}, {digits(size(16, 24))})",
        f"concat({other('phone ', 'tel ', 'call ')}, '+', {digits(3)}, '-', {digits(4, 'p')}, '-', {digits(8, 'q')})",
        f"concat({lead}, {word('e1')}, {word('e2')}, {word('e3')}, '_', {digits(3)}, '@mail.example.com')",
        f"concat('see https://', {word('h')}, '.example.org/', {word('p1')}, '/', {digits(4)}, '/', {word('p2')}, '-', {word('p3')}, '-', {digits(3, 'z')})",
        f"concat('open /', {common('f1')}, '/', {common('f2')}, '/', {common('f3')}, '_00', {digits(3)}, '.png')",
        f"concat({lead}, {common('c1')}, initcap({common('c2')}), initcap({common('c3')}), initcap({common('c5')}), {digits(1)})",
        f"concat({lead}, {common('s1')}, '_', {common('s2')}, '_', {common('s3')}, '_', {common('s4')}, {digits(2)})",
        f"concat({lead}, upper({common('s1')}), '_', upper({common('s2')}), '_', upper({common('s3')}), {digits(2)}, upper({common('s4')}))",
        f"concat({lead}, {name}, {sign}, {quote}, {other(*_FILLERS)}, {quote})",
        f"concat({lead}, {name}, ': ', {common('n1')}, {common('n2')})",
        f"concat({lead}, {name}, {sign}, {common('n1')}, '.', {common('n2')}, '(', {common('n3')}, ')')",
        f"concat({lead}, 'AKIA', 'EXAMPLE', {upper(9)})",
        f"concat({lead}, '20', {digits(2)}, '-0', {digits(1, 't')}, '-1', {digits(1, 'y')}, 'T', {digits(2, 'w')}, '-', {digits(2, 'v')}, '-', {digits(2, 'r')})",
        f"concat({lead}, {word('w1')}, {word('w2')}, {word('w3')}, {word('w4')}, {digits(2)})",
        f"concat('src=data:image/png;base64,', {base64(80)})",
        f"concat('integrity sha256-', {base64(44)})",
        f"concat({lead}, 'v', {digits(2)}, '-', {word('w1')}, '-', {word('w2')}, '-build', {digits(4, 'o')})",
    ]
    choose = lambda of: "element_at(array(" + ", ".join(of) + f"), cast(1 + pmod(id, {len(of)}) as int))"
    # A local relation: the rows are made and their features computed where the query is planned.
    made = spark.sql("SELECT bigint(id div 2) AS id, int(id % 2) AS label FROM VALUES " + ", ".join(f"({i})" for i in range(rows)) + " AS t(id)")
    return made.selectExpr("label", f"concat(case when label = 1 then {choose(secret)} else {choose(harmless)} end, ' ', {word('tail')}, ' ', {word('end')}) as text")


# --- the forest ------------------------------------------------------------------------------------------------


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree: a leaf's share of ones, or (feature, threshold, low, high), split by Gini impurity."""
    n, ones = len(y), y.sum()
    if depth == 0 or n < 2 * LEAST_LEAF or ones in (0, n):
        return float(ones / n)
    best = (2 * ones * (n - ones) / n - 1e-9, None)
    for f in rng.permutation(x.shape[1])[: int(np.sqrt(x.shape[1])) + 1]:
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])[:-1]
        size = np.arange(1, n)
        impurity = 2 * (left * (size - left) / size + (ones - left) * (n - size - ones + left) / (n - size))
        impurity[(v[1:] == v[:-1]) | (size < LEAST_LEAF) | (n - size < LEAST_LEAF)] = np.inf
        i = int(np.argmin(impurity))
        if impurity[i] < best[0]:
            best = (impurity[i], (int(f), float((v[i] + v[i + 1]) / 2)))
    if best[1] is None:
        return float(ones / n)
    f, threshold = best[1]
    low = x[:, f] <= threshold
    return (f, threshold, _grow(x[low], y[low], rng, depth - 1), _grow(x[~low], y[~low], rng, depth - 1))


def _tree_sql(tree, names: list[str]) -> str:
    if isinstance(tree, float):
        return f"{tree:.4f}D"
    f, threshold, low, high = tree
    return f"CASE WHEN f.{names[f]} <= {threshold!r}D THEN {_tree_sql(low, names)} ELSE {_tree_sql(high, names)} END"


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> str:
    """A SQL expression over a struct f of features, from labelled findings (label, text with one finding).

    The findings are collected: give a bounded table. A text without a candidate is left out, of several
    candidates the last counts.
    """
    rows = find_candidates(findings).where("size(found) > 0").withColumn("feature", F.expr(_feature_sql()))
    rows = rows.select("label", F.element_at("feature", -1).alias("f")).orderBy("label", "f").collect()
    grown = grow(np.array([list(r.f) for r in rows], float), np.array([r.label for r in rows], float), trees, depth, seed)
    return "(" + " + ".join(_tree_sql(t, list(FEATURES)) for t in grown) + f") / {trees}D"


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list:
    """Trees, each grown on as many rows as there are, drawn with repeats."""
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        own = rng.integers(0, len(y), len(y))
        grown.append(_grow(x[own], y[own], rng, depth))
    return grown


@lru_cache(maxsize=4)
def _default_forest(application: str) -> str:
    spark = SparkSession.getActiveSession()
    return train(labelled_findings(spark))


def default_forest(spark: SparkSession) -> str:
    """The forest of the default findings, trained once for each application."""
    return _default_forest(spark.sparkContext.applicationId)


def scored(df: DataFrame, forest: str, text: str = "text") -> DataFrame:
    """Adds rest, found, ends, and scores, the forest's score of each candidate."""
    df = find_candidates(df, text).withColumn("features", F.expr(_feature_sql()))
    return df.withColumn("scores", F.expr(f"transform(features, f -> {forest})")).drop("features")


def findings(docs: DataFrame, forest: str | None = None) -> DataFrame:
    """A row for each candidate in docs (doc_id, text): doc_id, start, length, value, kind, score, is_secret."""
    forest = forest or default_forest(docs.sparkSession)
    rows = scored(docs.select("doc_id", "text"), forest)
    each = rows.select("doc_id", F.posexplode(F.expr("arrays_zip(found, scores, ends)")).alias("n", "z"))
    each = each.selectExpr("doc_id", "z.found.value", "z.found.named", "z.scores as score", "z.ends as end")
    kind = F.when(F.col("value").startswith("-----BEGIN"), "private key").when(F.col("named"), "assigned value").otherwise("run")
    length = F.length("value").cast("long")
    return each.select("doc_id", (F.col("end") - length).alias("start"), length.alias("length"), "value", kind.alias("kind"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("is_secret"))


def redacted(text: str = "text") -> Column:
    """The text with its secrets replaced by MARK, over the columns of scored()."""
    value = f"if(scores[i] >= {THRESHOLD}D, concat(left(c.raw, length(c.raw) - length(c.value)), '{MARK}'), c.raw)"
    return F.when(F.exists("scores", lambda s: s >= THRESHOLD), F.expr(f"concat(rest[0], array_join(transform(found, (c, i) -> concat({value}, rest[i + 1])), ''))")).otherwise(F.col(text))


def redact(docs: DataFrame, forest: str | None = None) -> DataFrame:
    """docs with secrets in text replaced, and n_chars, if there is one, set anew where that changed the text.

    All rows and columns stay; a text without secrets stays as it is.
    """
    forest = forest or default_forest(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = scored(docs.select(row, "text"), forest).select("row", "text", redacted().alias("new"))
    columns = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            old = F.col("new")
        elif c == "n_chars":
            old = F.when(F.col("new").eqNullSafe(F.col("text")), old).otherwise(F.length("new").cast(docs.schema[c].dataType))
        columns.append(old.alias(c))
    return rows.select(columns)

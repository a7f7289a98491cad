"""Operator 10: secret scan with a random forest that removes false positives.

Candidates come from three patterns, each on what the one before it left: private-key blocks (also
PGP's and those without an end line); values of six or more characters right after the assignment of
a key word or in ``scheme://user:value@``; dotted web tokens and runs of 16 or more letters, digits and
``+ / _ -`` with at least one digit. What one pattern has found is blanked out for the next, so candidates
never overlap and begin and end where a token does. Every occurrence is described by its length, its
character transitions, how much of it dictionary words cover, the path (source) it stands in and the
words beside it; a random forest trained on labelled findings decides whether it is a secret.

Labelled findings are a table (value, before, after, path, label). Without one, ``labelled_findings``
makes it: public key formats and neutral look-alikes (card numbers, digests, ids, paths,
placeholders) in varied surroundings, ``rows`` of them (a documented bound), always the same.

Only DataFrame expressions and the JVM's ML library are used. Scanning is one map over whole texts
without shuffle: matches and the pieces between them give every place, so a text with very many
candidates costs no more than its length. The forest has a fixed size.

Defined results: null and empty texts have no findings; each occurrence is a finding of its own;
repeated rows give repeated findings; a null id or source is a null id or an empty path. ``redact`` keeps
every document and replaces all values found in the documents of its id, longest first, where they are whole tokens;
very long texts are read whole. Extra columns pass through ``redact``, whatever their names, and are not read otherwise.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, table

RUN = r"A-Za-z0-9+/_\-"
BEGIN = r"-----BEGIN [A-Z ]*PRIVATE KEY(?: BLOCK)?-----"
# Loops over groups are possessive: Java runs these without recursion, and a search for the end stops at the next beginning.
BLOCK = (
    BEGIN + r"[^\-]*+(?:-(?!----BEGIN |----END [A-Z ]{0,40}PRIVATE KEY)[^\-]*+)*+-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"|" + BEGIN + r"(?:\s++[A-Za-z\-]{1,40}+: [^\n]{0,200}+)*+(?:\s++[A-Za-z0-9+/=]{16,}+)++(?:\s++[A-Za-z0-9+/]++={1,2})?"
)
# Words whose neighbourhood speaks for or against a secret, words that names are made of, and public key prefixes.
KEY_WORDS = "token|secret|passw(?:or)?d|passwd|pwd|api[ _-]?key|apikey|access[ _-]?key|auth|bearer|credential|private[ _-]?key|client[ _-]?key"
PLAIN_WORDS = "commit|sha-?1|sha-?256|md5|checksum|digest|revision|uuid|card|order|invoice|phone|isbn|account number|image|base64,|version|build|request|session of|\\bid|row"
DICTIONARY = (
    "access", "account", "action", "address", "admin", "agent", "alpha", "archive", "array", "asset", "auth", "backup", "banner", "base", "batch", "beta", "bin", "black", "block",
    "blue", "board", "book", "box", "branch", "build", "bundle", "button", "cache", "change", "class", "client", "cloud", "code", "color", "common", "config", "connect", "content", "count",
    "data", "date", "day", "default", "demo", "detail", "dev", "docs", "document", "domain", "dummy", "email", "error", "event", "example", "feature", "field", "file", "filter", "first", "font", "form",
    "format", "frame", "function", "global", "green", "group", "handler", "header", "here", "home", "host", "http", "https", "icon", "image", "index", "input", "insert", "item", "java", "key", "label", "last",
    "layout", "lib", "line", "link", "list", "local", "log", "login", "main", "manager", "map", "master", "media", "menu", "message", "meta", "method", "mobile", "model", "module", "month", "name", "net", "network",
    "node", "number", "object", "option", "order", "output", "package", "page", "param", "password", "path", "pay", "placeholder", "plugin", "point", "port", "post", "prod", "product", "profile", "project", "public",
    "python", "query", "red", "release", "report", "request", "resource", "response", "result", "role", "root", "route", "sample", "script", "search", "secret", "section", "select", "server", "service", "session",
    "set", "site", "source", "start", "state", "static", "status", "store", "string", "style", "system", "table", "task", "template", "test", "text", "the", "theme", "time", "title", "token", "tool", "total",
    "type", "update", "upload", "url", "user", "usr", "util", "value", "version", "video", "view", "web", "widget", "window", "word", "work", "your",
)
PREFIXES = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|pk_live_|xox[abprs]-|eyJ|AIza|glpat-|npm_|SG\\."
ASSIGNMENT = "(?=[AaBbCcPpSsTt])(?i:" + KEY_WORDS + r")[A-Za-z0-9_]{0,12}[\"'`]?\s{0,2}(?::=|=>|=|:|\s(?=[\"']))\s{0,2}"
# A quoted value is all between the quotes; an unquoted one ends before a sentence's mark.
PLACED = ASSIGNMENT + r"(?:[\"'`]([^\s\"'`]{6,})(?=[\"'`])|[\"'`]?([^\s\"'`]{5,}[^\s\"'`,;.!?:)\]}>]))" + r"|://[^\s/:@\"'`]+:([^\s/@\"'`]{6,})(?=@)"
FREE = (
    r"(?<![" + RUN + r".])eyJ[A-Za-z0-9_\-]{4,}(?:\.[A-Za-z0-9_\-]{4,}){1,2}"
    r"|(?<![" + RUN + r"])(?=[A-Za-z+/_\-]*+[0-9])[" + RUN + r"]{16,}+={0,2}"
)
NEAR = 48
FOUND = "array<struct<value:string,start:int,before:string,after:string>>"


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a named value, which is so computed once."""
    return F.transform(F.array(value), body)[0]


def running(sizes: Column) -> Column:
    """The sum of all entries up to each, by doubling: no array grows entry by entry."""
    more = lambda s, step: F.transform(s, lambda x, i: x + F.coalesce(F.get(s, i - step), F.lit(0)))
    return F.aggregate(F.lit([1 << k for k in range(29)]), sizes, lambda s, step: F.when(F.size(s) > step, more(s, step)).otherwise(s))


def matches(text: Column, pattern: str, groups: int = 0) -> Column:
    """struct<found, rest> for one pattern: its values with their places, and the text with blanks in their stead.

    A match's value is the group that took part (the whole match without groups) and ends where the match ends. One
    split gives the pieces between the matches, so places are sums of lengths and nothing is searched twice."""

    def of(p: Column, m: Column) -> Column:
        head = lambda x: F.left(x["m"], F.length(x["m"]) - F.length(x["v"]))
        last = lambda i: F.when(i > 0, F.right(F.get(m, i - 1)["m"], F.lit(NEAR))).otherwise("")
        following = lambda i: F.coalesce(F.left(F.get(m, i + 1)["m"], F.lit(NEAR)), F.lit(""))
        ends = running(F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x["m"])))
        found = let(ends, lambda e: F.transform(m, lambda x, i: F.struct(
            x["v"].alias("value"), (F.get(e, i) - F.length(x["v"]) + 1).alias("start"),
            F.right(F.concat(last(i), F.get(p, i), head(x)), F.lit(NEAR)).alias("before"), F.left(F.concat(F.get(p, i + 1), following(i)), F.lit(NEAR)).alias("after"),
        )))
        blank = F.transform(m, lambda x, i: F.concat(F.get(p, i), head(x), F.repeat(F.lit(" "), F.length(x["v"]))))
        return F.struct(found.alias("found"), F.concat(F.array_join(blank, ""), F.element_at(p, -1)).alias("rest"))

    def named(w: Column) -> Column:
        taken = F.array(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)) for i in range(groups)]) if groups else F.lit(None)
        valued = lambda g: F.transform(w, lambda m, i: F.struct(m.alias("m"), F.coalesce(*[F.nullif(F.get(F.get(g, F.lit(k)), i), F.lit("")) for k in range(groups)], m).alias("v")))
        both = let(taken, lambda g: let(valued(g), lambda v: let(F.split(text, pattern, -1), lambda p: of(p, v))))
        return F.when(F.size(w) > 0, both).otherwise(F.struct(F.array().cast(FOUND).alias("found"), text.alias("rest")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), named)


def occurrences(text: Column) -> Column:
    """Every candidate in its place: array<struct<value, start, before, after>>."""
    blocks = lambda t: F.when(t.contains("PRIVATE KEY"), matches(t, BLOCK)).otherwise(F.struct(F.array().cast(FOUND).alias("found"), t.alias("rest")))
    return let(text, lambda t: let(blocks(t), lambda a: let(matches(a["rest"], PLACED, 3), lambda b: F.concat(a["found"], b["found"], matches(b["rest"], FREE)["found"]))))


def described(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the features of (value, before, after, path)."""
    v, b, a, path = F.col("value"), F.lower("before"), F.lower("after"), F.lower(F.coalesce("path", F.lit("")))
    n = F.length(v)

    def rate(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    # Dictionary words among the pieces between marks, digits and changes of case.
    pieces = F.filter(F.split(v, "[^A-Za-z]+|(?<=[a-z])(?=[A-Z])"), lambda x: F.lower(x).isin(*DICTIONARY))
    covered = F.aggregate(pieces, F.lit(0), lambda a, x: a + F.length(x)) / n
    flag = lambda c: c.cast("double")
    columns = {
        "f_length": n.cast("double"),
        "f_digits": rate("[0-9]"), "f_upper": rate("[A-Z]"), "f_lower": rate("[a-z]"), "f_marks": rate(r"[+/_\-=]"), "f_slashes": rate("/"), "f_dashes": rate("-"),
        "f_letter_digit": rate("(?<=[A-Za-z])(?=[0-9])"), "f_digit_letter": rate("(?<=[0-9])(?=[A-Za-z])"),
        "f_case_change": rate("(?<=[a-z])(?=[A-Z])"), "f_vowel_change": rate("(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])"),
        "f_repeats": rate(r"(.)(?=\1)"), "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "f_hex": flag(v.rlike(r"\A[0-9a-fA-F]+\z")), "f_all_digits": flag(v.rlike(r"\A[0-9\-]+\z")), "f_prefix": flag(v.rlike(r"\A(?:" + PREFIXES + ")")),
        "f_block": flag(v.rlike(r"\A-----BEGIN ")), "f_uuid": flag(v.rlike(r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")),
        "f_dictionary": covered,
        "f_key_word": flag(b.rlike(KEY_WORDS)), "f_key_close": flag(b.rlike("(?:" + KEY_WORDS + r")\S{0,12}\s{0,2}[=:>]{0,2}\s{0,2}[\"'`]?\z")),
        "f_password": flag(b.rlike(r"(?:passw(?:or)?d|pwd)\S{0,12}\s{0,2}[=:>]{0,2}\s{0,2}[\"'`]?\z")), "f_dotted": flag(v.rlike(r"\A[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{8,}){1,2}\z")),
        "f_plain_word": flag(b.rlike("(?:" + PLAIN_WORDS + r")\W{0,6}\z")), "f_assigned": flag(b.rlike(r"[=:]\s{0,2}[\"'`]?\z")),
        "f_quoted": flag(b.rlike(r"[\"'`]\z") & a.rlike(r"\A[\"'`]")), "f_in_address": flag(b.rlike(r"[@.]\z") | a.rlike(r"\A[@.][a-z]")),
        "f_in_url": flag(b.rlike(r"[^\s/:@\"'`]:\z") & a.startswith("@")), "f_other_marks": rate(r"[^A-Za-z0-9+/_\-=]"), "f_vowels": rate("(?i)[aeiou]"),
        "f_code": flag(v.rlike(r"[(\[]|\A[$<{%*]|\A[A-Za-z_]+(?:\.[A-Za-z_]+)+\z|\*{3}")), "f_word": flag(v.rlike(r"\A[A-Z]?[a-z]+[.!?:)]*\z")),
        "f_test_path": flag(path.rlike("test|example|sample|mock|fixture|doc")),
    }
    return found.withColumns(columns), list(columns)


def labelled_findings(spark: SparkSession, rows: int = 4_000) -> DataFrame:
    """Labelled findings (value, before, after, path, label) from public formats, made without chance."""
    base = spark.range(rows).select(
        F.col("id"), *[F.md5(F.concat(F.lit(x), F.col("id").cast("string"))).alias(f"h{x}") for x in "abcd"],
        *[F.pmod(F.xxhash64("id", F.lit(x)), F.lit(997)).cast("int").alias(f"r{x}") for x in "klmn"],
    )

    def pick(r: str, *options: str) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), F.pmod(F.col(r), F.lit(len(options))) + 1)

    b64 = F.translate(F.base64(F.unhex(F.concat("ha", "hb"))), "=", "")
    alnum = F.regexp_replace(b64, "[+/]", "x")
    digits = F.substring(F.regexp_replace(F.concat("ha", "hb", "hc"), "[a-f]", ""), 1, 16)
    hex40, hex64 = F.concat("ha", F.substring("hb", 1, 8)), F.concat("ha", "hb")
    uuid = F.concat_ws("-", *[F.substring("ha", s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    name = F.concat_ws("_", pick("rk", "inter", "report", "module", "user", "client", "widget"), pick("rl", "national", "request", "package", "version", "profile"), pick("rm", "service", "number", "index", "handler"), (F.col("rn") + 10).cast("string"))
    path = F.concat(pick("rk", "/usr/lib/", "/home/user/", "src/main/", "https/www/"), pick("rl", "python3", "java8", "node18"), pick("rm", "/site-packages/", "/modules/", "/resources/"), pick("rn", "index2", "data_2024", "page10"))
    block = F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), F.base64(F.unhex(F.concat("ha", "hb", "hc", "hd"))), F.lit("\n-----END RSA PRIVATE KEY-----"))
    key_lines = F.concat(F.base64(F.unhex(F.concat("ha", "hb"))), F.lit("\n"), F.base64(F.unhex(F.concat("hc", "hd"))))
    open_block = F.concat(pick("rk", "-----BEGIN RSA PRIVATE KEY-----\n", "-----BEGIN PRIVATE KEY-----\n", "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: 2\n\n"), key_lines)
    odd_block = F.concat(F.lit("-----BEGIN OPENSSH PRIVATE KEY-----\n"), pick("rk", "redacted (see", "\\E[ x", "* line *", "a.b.c"), F.lit(" "), F.substring("ha", 1, 9), F.lit("\n-----END OPENSSH PRIVATE KEY-----"))
    pgp_block = F.concat(F.lit("-----BEGIN PGP PRIVATE KEY BLOCK-----\n\n"), key_lines, F.lit("\n-----END PGP PRIVATE KEY BLOCK-----"))
    short = F.concat(pick("rk", "hunter", "dragon", "pa55w", "Summer", "kitt", "Qwe", "blue"), F.substring("hb", 1, 3), (F.pmod("rn", F.lit(90)) + 10).cast("string"), pick("rm", "", "x", "Z"))
    marked = F.concat(F.substring(alnum, 1, 4), pick("rk", "!", "@", "#", "$", "."), F.substring(alnum, 5, 3), pick("rn", "!", "$", "", "#", "@9"), F.substring(alnum, 9, 2))
    letters = F.translate(hex40, "0123456789ae", "ghkqzmnpxwtv")
    common = F.concat(pick("rk", "requir", "incorrect", "pleas", "position", "enabl", "optional", "forgott", "strong", "generat", "provid"), pick("rn", "ed", "es", "ing", "ly", "er", "ion"), pick("rm", "", ".", "", "!"))
    code = F.concat(pick("rk", "getpass.getpass()", "os.environ", "${DB_PASSWORD}", "<password>", "********", "config.secret", "$TOKEN_VALUE", "{{token}}", "settings.auth.key", "request.get(x)"), pick("rn", "", "", ")", ""))
    phrase = F.concat_ws("-", pick("rk", "correct", "orange", "silent", "winter", "copper"), pick("rl", "river", "donkey", "garden", "lantern"), pick("rm", "pencil", "cloud", "velvet", "anchor", "summer"), pick("rn", "tiger", "stone", "ladder"))
    chat_token = F.concat(pick("rk", "xoxb-", "xoxp-"), F.substring(digits, 1, 11), F.lit("-"), F.substring(alnum, 1, 24))
    dotted = F.concat(F.lit("eyJ"), F.substring(alnum, 1, 20), F.lit(".eyJ"), F.substring(alnum, 15, 20), F.lit("."), F.substring(alnum, 3, 30))
    version = F.concat_ws(".", pick("rk", "org", "com", "net", "eyJobject"), pick("rl", "example", "service", "company"), pick("rm", "module2", "handler1", "package3"))
    stamp = F.concat(F.lit("2024-0"), (F.pmod("rk", F.lit(9)) + 1).cast("string"), F.lit("-1"), F.pmod("rl", F.lit(10)).cast("string"), F.lit("T10-"), (F.pmod("rm", F.lit(50)) + 10).cast("string"), F.lit("-00Z"))
    filler = F.concat_ws(" ", pick("rk", "of the", "see also", "set the", "then", "here is", "we use", "", "| note |"), pick("rn", "in", "with", "the", "for", "our", ","))
    word = pick("rl", "token", "secret", "password", "api_key", "API_KEY", "access_key", "auth_token", "TOKEN", "client_secret", "Authorization", "my_token", "DB_PASSWORD")
    assign = pick("rm", " = \"", "=", ": ", " = '", ": \"", "=\"", " := ", "\": \"", " ")
    closing = F.when(assign.endswith("\""), "\"").when(assign.endswith("'"), "'").otherwise("")
    keyed, key_after = F.concat(filler, F.lit(" "), word, assign), F.concat(closing, pick("rk", " of the", "\n", "", "; ", ",", " and"))
    pass_keyed = F.concat(filler, pick("rl", " password", " PASSWORD", " DB_PASSWORD", " db_pwd", " passwd"), F.when(closing == "", F.lit("=")).otherwise(assign))
    plain_before = lambda *w: F.concat(filler, F.lit(" "), pick("rl", *w), pick("rm", " ", ": ", " is ", " no. ", "="))
    plain_after = pick("rk", " of the", ".", ",", "\n", " and", "; ", ") ")
    # A look-alike shortly after a secret that is not its own.
    beside = F.concat(word, F.lit(' = "'), F.substring("hd", 1, 20), F.lit('"'), pick("rm", ", ", " and ", "; "), pick("rl", "id", "commit", "digest", "order", "row", "build"), F.lit(" "))
    prose = F.concat(filler, F.lit(" "))
    key_path, doc_path = pick("rn", "app/config.py", "deploy.sh", "web", "infra/main.tf", ""), pick("rn", "docs/readme", "tests/fixture", "web", "examples/demo", "")
    secret_hex = F.when(F.pmod("rn", F.lit(3)) == 0, F.upper(hex40)).otherwise(hex40)
    parts = {
        "secret_hex": secret_hex, "hex40": hex40, "hex64": hex64, "b64": b64, "alnum": alnum, "digits": digits, "uuid": uuid, "name": name, "where": path, "block": block, "stamp": stamp,
        "filler": filler, "keyed": keyed, "key_after": key_after, "pass_keyed": pass_keyed, "beside": beside, "plain_after": plain_after, "prose": prose, "key_path": key_path, "doc_path": doc_path,
        "open_block": open_block, "pgp_block": pgp_block, "short": short, "marked": marked, "letters": letters, "odd_block": odd_block, "phrase": phrase, "chat_token": chat_token, "dotted": dotted, "version": version, "common": common, "code": code, "url": F.concat(filler, pick("rl", " postgres", " https", " amqp", " redis"), F.lit("://"), pick("rm", "bob:", "admin:", "svc_1:")), "url_after": pick("rk", "@db.host/x", "@10.0.0.1:80", "@example.org and"),
    }
    base = materialise(base.withColumns(parts), "secret-parts")
    (secret_hex, hex40, hex64, b64, alnum, digits, uuid, name, path, block, stamp, filler, keyed, key_after, pass_keyed, beside, plain_after, prose, key_path, doc_path,
     open_block, pgp_block, short, marked, letters, odd_block, phrase, chat_token, dotted, version, common, code, url, url_after) = map(F.col, parts)
    # Kinds in turn: value, before, after, path, label.
    kinds = [
        (secret_hex, keyed, key_after, key_path, 1), (F.col("ha"), keyed, key_after, key_path, 1), (hex64, keyed, key_after, key_path, 1),
        (b64, keyed, key_after, key_path, 1), (F.substring(alnum, 1, 20), keyed, key_after, key_path, 1), (secret_hex, keyed, key_after, doc_path, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring("hb", 1, 16))), prose, plain_after, key_path, 1), (F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)), prose, plain_after, key_path, 1),
        (F.concat(pick("rk", "gho_", "ghs_", "sk_live_"), F.substring(hex40, 1, 24)), prose, plain_after, key_path, 1), (F.concat(pick("rk", "gho_", "ghs_", "sk-"), F.upper(F.substring(hex40, 1, 32))), plain_before("key", "use", "set"), plain_after, key_path, 1), (F.substring(hex40, 1, 10), url, url_after, key_path, 1), (F.concat(F.lit("sk-"), alnum), keyed, key_after, key_path, 1), (F.concat(F.lit("eyJ"), alnum), prose, plain_after, key_path, 1), (block, prose, plain_after, doc_path, 1),
        (digits, prose, plain_after, doc_path, 0), (digits, plain_before("card", "account number", "invoice", "order"), plain_after, key_path, 0), (digits, prose, plain_after, key_path, 0),
        (uuid, plain_before("id", "uuid", "request", "session of"), plain_after, doc_path, 0), (uuid, filler, plain_after, key_path, 0),
        (hex40, plain_before("commit", "revision", "sha1"), plain_after, doc_path, 0), (hex64, plain_before("sha256", "checksum", "digest"), plain_after, doc_path, 0), (F.col("ha"), plain_before("md5", "digest"), plain_after, doc_path, 0),
        (F.substring(hex40, 1, 26), beside, plain_after, key_path, 0), (hex40, beside, plain_after, doc_path, 0), (name, prose, plain_after, doc_path, 0), (name, keyed, key_after, doc_path, 0), (path, prose, plain_after, doc_path, 0), (stamp, prose, plain_after, doc_path, 0),
        (F.concat(pick("rk", "your_token_here_", "example_key_", "insert-your-key-", "changeme-password-"), F.lit("12345678")), keyed, key_after, doc_path, 0),
        (F.concat(F.repeat(F.lit("x"), 20), F.lit("1")), keyed, key_after, doc_path, 0), (F.concat(b64, b64), plain_before("image", "base64,"), plain_after, doc_path, 0),
        (open_block, prose, plain_after, key_path, 1), (odd_block, prose, plain_after, key_path, 1), (pgp_block, prose, plain_after, doc_path, 1), (short, keyed, key_after, key_path, 1), (marked, keyed, key_after, key_path, 1),
        (letters, keyed, key_after, key_path, 1), (F.substring(letters, 1, 20), keyed, key_after, doc_path, 1), (short, url, url_after, key_path, 1), (marked, url, url_after, doc_path, 1),
        (chat_token, prose, plain_after, key_path, 1), (dotted, prose, plain_after, doc_path, 1), (dotted, keyed, key_after, key_path, 1), (version, keyed, key_after, doc_path, 0),
        (phrase, pass_keyed, key_after, key_path, 1), (short, pass_keyed, key_after, doc_path, 1), (F.concat(short, short), keyed, key_after, key_path, 1), (common, pass_keyed, key_after, doc_path, 0),
        (common, keyed, key_after, doc_path, 0), (common, keyed, key_after, key_path, 0), (code, keyed, key_after, key_path, 0), (code, url, url_after, doc_path, 0),
    ]
    turn = F.pmod(F.col("id"), F.lit(len(kinds)))
    made = base.select(*[
        F.coalesce(*[F.when(turn == i, k[at] if at < 4 else F.lit(k[4])) for i, k in enumerate(kinds)]).alias(c) for at, c in enumerate(("value", "before", "after", "path", "label"))
    ])
    return materialise(made, "secret-labels")


def train(labelled: DataFrame, trees: int = 30, depth: int = 8) -> RandomForestClassificationModel:
    data, features = described(labelled.where(F.length("value") > 0))
    data = VectorAssembler(inputCols=features, outputCol="features").transform(data).select("features", F.col("label").cast("double").alias("label"))
    data = materialise(data, "secret-features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="onethird").fit(data)


def scan(docs: DataFrame, model: RandomForestClassificationModel, *, keep_at: float = 0.5, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Findings that the forest takes for secrets: (doc_id, text_key, start, value, before, after, score); ``text_key`` is a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.col(source_col).alias("path"), F.explode(occurrences(text)).alias("o")).select(
        "doc_id", "text_key", "path", "o.value", "o.start", "o.before", "o.after"
    )
    data, features = described(found)
    data = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(data))
    return data.withColumn("score", vector_to_array("probability")[1]).where(F.col("score") >= keep_at).select("doc_id", "text_key", "start", "value", "before", "after", "score")


def literal(value: Column) -> Column:
    """A pattern that matches the value itself, as a whole token where it begins or ends with a token's characters."""
    quoted = F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    before = F.when(value.rlike(r"\A(?!-----BEGIN )[" + RUN + "]"), "(?<![" + RUN + "])").otherwise("")
    return F.concat(before, quoted, F.when(value.rlike("[" + RUN + r"]\z"), "(?![" + RUN + "])").otherwise(""))


BROADCAST_BYTES = 64 << 20


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """``docs`` with every found value replaced; ``n_chars`` follows where it exists.

    Values are gathered per text (id and hash), so neither a null nor a repeated id gathers more than its own text's. They are
    broadcast while they take at most ``BROADCAST_BYTES``, as measured; beyond, texts are shuffled to them."""
    found = materialise(findings.select("doc_id", "text_key", "value"), "secret-findings")
    size = found.agg(F.sum(F.octet_length("value") + 32)).first()[0] or 0
    own = F.transform(F.array_sort(F.collect_set(F.struct((-F.length("value")).alias("n"), "value"))), lambda f: literal(f["value"]))
    by_text = found.groupBy("doc_id", "text_key").agg(F.array_join(own, "|").alias("pattern"))
    by_text = by_text.select(F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "pattern").alias("__secrets"))
    if size <= BROADCAST_BYTES:
        by_text = F.broadcast(by_text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    text, ours = F.col("__row")[text_col], F.col("__secrets")
    same = F.xxhash64(F.coalesce(text, F.lit(""))) == ours["key"]
    safe = mark.replace("\\", "\\\\").replace("$", "\\$")
    clean = F.when(ours.isNotNull(), F.regexp_replace(text, ours["pattern"], F.lit(safe))).otherwise(text)
    out = rows.join(by_text, same & F.col("__row")["doc_id"].eqNullSafe(ours["id"]), "left").withColumn("__clean", clean)
    columns = {c: F.col("__row")[c] for c in docs.columns} | {text_col: F.col("__clean")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(ours.isNotNull(), F.length("__clean")).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[v.alias(c) for c, v in columns.items()])


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret found in the documents, by place; the value itself only as a digest."""
    found = scan(table(spark, sf_dir, "documents"), train(labelled_findings(spark)))
    return found.select("doc_id", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "score")

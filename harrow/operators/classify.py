"""Page classification: blocked pages, captchas, script shells, protection systems. Rules are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.functions import text as X

# What blocked pages say, and what marks challenges and script shells.
BLOCKED = (
    "access denied", "captcha", "cf-challenge", "just a moment", "checking your browser", "rate limit", "too many requests", "verify you are human",
    "please complete the security check", "please turn javascript on", "enable javascript", "please enable cookies", "automated access", "bot detection",
    "unusual traffic", "sorry, you have been blocked", "one more step", "attention required",
)
TITLES = ("just a moment", "attention required", "access denied", "security check", "are you a robot", "one more step", "please wait", "ddos-guard")
SHELLS = ('<div id="root"></div>', '<div id="app"></div>', '<div id="__next"></div>', "__NEXT_DATA__", "window.__NUXT__", "ng-app", 'id="__nuxt"')
HEADERS = ("cf-ray", "cf-mitigated", "x-datadome", "x-datadome-cid", "x-kpsdk-ct", "x-sucuri-id", "x-distil-cs")
SCRIPTS = ("/cdn-cgi/challenge-platform/", "js.datadome.co", "client.perimeterx.net", "awswaf", "_kpsdk")
CAPTCHA = ("captcha", "cf-turnstile", "g-recaptcha", "h-captcha", "verify you are human", "please complete the security check")
# Fixed values: (system, weight, signal, where, how, words); all words of a rule must be found where how ends in "all".
RULES = (
    ("cloudflare", 0.5, "cf_clearance cookie", "cookie", "prefix", ("cf_clearance",)),
    ("cloudflare", 0.3, "cf_ cookie prefix", "cookie", "prefix", ("cf_",)),
    ("cloudflare", 0.4, "cf-mitigated header", "header", "name", ("cf-mitigated",)),
    ("cloudflare", 0.3, "cf-ray header", "header", "name", ("cf-ray",)),
    ("cloudflare", 0.5, "challenge page title", "html", "pattern", (r"(?i)<title>\s*Just a moment\.\.\.\s*</title>",)),
    ("cloudflare", 0.3, "cloudflare challenge script", "html", "any", ("/cdn-cgi/challenge-platform/",)),
    ("cloudflare", 0.2, "server: cloudflare", "header", "server", ("cloudflare",)),
    ("akamai", 0.6, "_abck cookie", "cookie", "prefix", ("_abck",)),
    ("akamai", 0.4, "bm_sz cookie", "cookie", "prefix", ("bm_sz",)),
    ("akamai", 0.3, "ak_bmsc cookie", "cookie", "prefix", ("ak_bmsc",)),
    ("akamai", 0.2, "akamai script", "html", "any", ("akamaihd.net",)),
    ("perimeterx", 0.7, "_px cookie", "cookie", "prefix", ("_px",)),
    ("perimeterx", 0.4, "px-captcha", "html", "any", ("px-captcha",)),
    ("perimeterx", 0.3, "perimeterx script", "html", "any", ("client.perimeterx.net",)),
    ("datadome", 0.7, "datadome cookie", "cookie", "prefix", ("datadome",)),
    ("datadome", 0.4, "x-datadome header", "header", "prefix", ("x-datadome",)),
    ("datadome", 0.3, "datadome script", "html", "any", ("js.datadome.co",)),
    ("kasada", 0.7, "x-kpsdk header", "header", "prefix", ("x-kpsdk",)),
    ("kasada", 0.4, "kasada script", "html", "all", ("ips.js", "_kpsdk")),
    ("aws-waf", 0.6, "aws-waf-token cookie", "cookie", "prefix", ("aws-waf-token",)),
    ("aws-waf", 0.3, "awswaf challenge", "html", "any", ("awswaf",)),
    ("f5-shape", 0.5, "TS cookie prefix", "cookie", "pattern", ("^ts[a-f0-9]{6,}",)),
    ("f5-shape", 0.3, "shape script", "html", "any", ("shape.js", "shapesecurity.com")),
    ("incapsula", 0.6, "_incap_ses_ cookie", "cookie", "prefix", ("_incap_ses_",)),
    ("incapsula", 0.6, "visid_incap cookie", "cookie", "prefix", ("visid_incap",)),
    ("incapsula", 0.3, "incap_ses cookie", "cookie", "any", ("incap",)),
    ("incapsula", 0.4, "incapsula script", "html", "any", ("incapsula", "imperva")),
    ("incapsula", 0.3, "x-iinfo header", "header", "name", ("x-iinfo",)),
    ("sucuri", 0.7, "sucuri cookie", "cookie", "any", ("sucuri",)),
    ("sucuri", 0.4, "x-sucuri-id header", "header", "name", ("x-sucuri-id",)),
    ("sucuri", 0.3, "sucuri script/content", "html", "all", ("sucuri", "cloudproxy")),
    ("geetest", 0.7, "geetest script", "html", "any", ("geetest", "gt.js")),
    ("geetest", 0.5, "geetest captcha div", "html", "any", ("geetest_", "gt_captcha")),
    ("distil", 0.6, "D= cookie", "cookie", "pattern", ("^d(=.*)?$",)),
    ("distil", 0.5, "distil script", "html", "any", ("distil", "distilnetworks")),
    ("distil", 0.3, "x-distil-cs header", "header", "name", ("x-distil-cs",)),
)
LEVELS = {"aws-waf": 2, "sucuri": 2, "none": 1}  # every other system needs level 3


def is_blocked(html: Column, status: Column, headers: Column) -> Column:
    """Layered: statuses count with a protection's header or script, phrases on small pages only. Header names in lower case."""
    heading = X.trim(X.title(html))
    protected = F.exists(F.map_keys(headers), lambda k: k.isin(*HEADERS)) | X.contains_any(html, SCRIPTS)
    links = F.size(F.regexp_extract_all(html, F.lit(r"(?i)(<a\s)"), F.lit(1)))
    facts = lambda t: F.struct(
        F.length(t).alias("size"), X.once(F.lower(t), lambda low: X.contains_any(low, BLOCKED)).alias("phrase"), protected.alias("protected"),
        X.matches_any(heading, [f"(?i){p}" for p in TITLES]).alias("challenge"), links.alias("links"),
    )

    def verdict(x: Column) -> Column:
        small = x["size"] < 5000
        return (
            F.when(F.coalesce(F.try_element_at(headers, F.lit("cf-mitigated")), F.lit("")) != "", True)
            .when(status.isin(403, 429, 503), x["protected"] | (small & (x["challenge"] | x["phrase"])))
            .when((x["size"] > 5000) & (x["links"] > 10), False)
            .when(x["challenge"], True)
            .when(small & x["phrase"] & (x["protected"] | (x["size"] < 1000)), True)
            .otherwise(html.rlike(r"(?i)</title>") & html.rlike(r"(?i)<title[^>]*>.*?</title>") & (x["size"] < 50) & (status >= 400))
        )

    return X.once(X.once(X.body_text(html), facts), verdict)


def is_captcha(html: Column) -> Column:
    return X.contains_any(F.lower(html), CAPTCHA)


def needs_scripts(html: Column) -> Column:
    small = X.once(X.inner_body(html), lambda x: F.coalesce(F.length(X.trim(X.without_scripts(x))) < 100, F.lit(False)))
    return small | X.contains_any(html, SHELLS)


def _fires(rule, html: Column, headers: Column, cookies: Column) -> Column:
    _, _, _, where, how, words = rule
    if where == "html":
        if how == "pattern":
            return html.rlike(words[0])
        hits = [html.contains(w) for w in words]
        out = hits[0]
        for h in hits[1:]:
            out = (out & h) if how == "all" else (out | h)
        return out
    if how == "server":
        return F.coalesce(F.lower(F.try_element_at(headers, F.lit("server"))) == words[0], F.lit(False))
    held = F.map_keys(headers) if where == "header" else cookies
    test = {"prefix": lambda k: k.startswith(words[0]), "name": lambda k: k == words[0], "any": lambda k: k.contains(words[0]), "pattern": lambda k: k.rlike(words[0])}[how]
    return F.exists(held, test)


def signals(html: Column, headers: Column, cookies: Column) -> Column:
    """An array of (rule, system, weight, signal) of the rules that fire; one expression, no join with the rules."""
    all_of = [
        F.when(_fires(r, html, headers, cookies), F.struct(F.lit(k).alias("rule"), F.lit(r[0]).alias("system"), F.lit(r[1]).alias("weight"), F.lit(r[2]).alias("signal")))
        for k, r in enumerate(RULES)
    ]
    return F.filter(F.array(*all_of), lambda x: x.isNotNull())


def protection(pages: DataFrame, key: str, html: str, headers: str, cookies: str) -> DataFrame:
    """(key, system, confidence, level, signals): the system of the greatest weight; the first rule decides ties. One projection."""
    systems = list(dict.fromkeys(r[0] for r in RULES))
    exact = "decimal(10,2)"

    def weighed(fired: Column) -> Column:
        def of(name: str) -> Column:
            return X.once(F.filter(fired, lambda x: x["system"] == name), lambda own: F.when(F.size(own) > 0, F.struct(
                F.aggregate(own, F.lit(0).cast(exact), lambda acc, x: (acc + x["weight"].cast(exact)).cast(exact)).alias("score"), (-own[0]["rule"]).alias("first"), F.lit(name).alias("system"), own["signal"].alias("signals"),
            )))

        return F.array_max(F.array(*[of(name) for name in systems]))

    best = X.once(signals(F.col(html), F.col(headers), F.col(cookies)), weighed)
    out = pages.select(key, X.once(F.struct(best.alias("best"), unknown_signals(F.col(html)).alias("odd")), lambda x: x).alias("x")).select(key, "x.*")
    known, odd = F.col("best").isNotNull(), F.size("odd") > 0
    system = F.when(known, F.col("best.system")).when(odd, "unknown").otherwise("none")
    level = F.lit(3)
    for s, n in LEVELS.items():
        level = F.when(system == s, n).otherwise(level)
    confidence = F.when(known, F.least(F.col("best.score").cast("double"), F.lit(1.0))).when(odd, 0.3).otherwise(0.0)
    return out.select(key, system.alias("system"), confidence.alias("confidence"), level.alias("level"), F.when(known, F.col("best.signals")).otherwise(F.col("odd")).alias("signals"))


def unknown_signals(html: Column) -> Column:
    def facts(inner: Column) -> Column:
        text = X.text_of(F.coalesce(inner, F.lit("")))
        scripts = F.size(F.regexp_extract_all(inner, F.lit("(?i)(<script)"), F.lit(1)))
        return F.struct(F.length(text).alias("size"), scripts.alias("scripts"), inner.contains("<noscript>").alias("fallback"), inner.isNotNull().alias("has"))

    def found(x: Column) -> Column:
        return F.array(
            F.when(x["has"] & (x["size"] < 200) & (x["scripts"] >= 2), "small body with multiple scripts"),
            F.when(x["has"] & x["fallback"] & (x["size"] < 500) & (x["scripts"] >= 3), "noscript fallback with script-heavy body"),
            F.when(html.contains("window.location") & html.contains("document.cookie"), "JS redirect with cookie manipulation"),
        )

    return F.filter(X.once(X.once(X.inner_body(html), facts), found), lambda x: x.isNotNull())


def cookie_names(headers: Column) -> Column:
    return F.transform(headers, lambda c: F.trim(F.split(c, "=")[0]))


# What tells of a widget, where its key stands, and what tells versions apart.
UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
TURNSTILE, HCAPTCHA = ("cf-turnstile", "challenges.cloudflare.com/turnstile"), ("h-captcha", "hcaptcha")
RECAPTCHA = ("g-recaptcha", "grecaptcha", "recaptcha/api")
TURNSTILE_KEYS = (
    r"""class=["'][^"']*cf-turnstile[^"']*["'][^>]*data-sitekey=["']([A-Za-z0-9_-]+)["']""",
    r"""data-sitekey=["']([A-Za-z0-9_-]+)["'][^>]*class=["'][^"']*cf-turnstile""",
    r"""turnstile\.render\s*\([^,]{0,500},\s*\{[^}]*sitekey['"]\s*:\s*['"]([A-Za-z0-9_-]+)["']""",
)
HCAPTCHA_KEYS = (
    rf"""data-sitekey=["']({UUID})["']""", r"""hcaptcha\.render\s*\([^,]{0,500},\s*\{[^}]*sitekey['"]\s*:\s*['"]([0-9a-f-]{36})["']""", rf"""['"]sitekey['"]\s*:\s*['"]({UUID})["']""",
)
RECAPTCHA_KEYS = (
    r"""data-sitekey=["']([A-Za-z0-9_-]{40})["']""", r"""grecaptcha\.render\s*\([^,]{0,500},\s*\{\s*['"]?sitekey['"]?\s*:\s*['"]([A-Za-z0-9_-]{40})["']""",
    r"""['"]sitekey['"]\s*:\s*['"]([A-Za-z0-9_-]{40})["']""", r"recaptcha/api2?/anchor\?.*?k=([A-Za-z0-9_-]{40})", r"recaptcha/enterprise/anchor\?.*?k=([A-Za-z0-9_-]{40})",
)
RECAPTCHA_RENDER = r"recaptcha/(?:enterprise/)?api\.js\?.*?render=([A-Za-z0-9_-]{40})"
RECAPTCHA_V3 = ("grecaptcha.execute", "recaptcha/api.js?render=", "recaptcha/enterprise.js?render=", "recaptcha-v3", '"size":"invisible"')
ENTERPRISE = ("recaptcha/enterprise", "grecaptcha.enterprise")
ACTION = r"""grecaptcha\.(?:enterprise\.)?execute\s*\(\s*['"][^'"]*['"]\s*,\s*\{\s*action\s*:\s*['"]([^'"]+)['"]"""


def captcha(html: Column) -> Column:
    """(kind, sitekey, action, enterprise, s) of the first of three widgets whose key is found; nulls for none.

    ``kind``: turnstile, hcaptcha, recaptcha_v2 or recaptcha_v3; ``action`` (v3: "verify" where none is named), ``enterprise``
    and ``s`` belong to the last two.
    """
    found = lambda p: F.when(F.regexp_extract(html, p, 1) != "", F.regexp_extract(html, p, 1))
    key = lambda patterns: F.coalesce(*[found(p) for p in patterns])
    keys = F.struct(
        F.when(X.contains_any(html, TURNSTILE), key(TURNSTILE_KEYS)).alias("turnstile"), F.when(X.contains_any(html, HCAPTCHA), key(HCAPTCHA_KEYS)).alias("hcaptcha"),
        F.coalesce(key(RECAPTCHA_KEYS), F.when(X.contains_any(html, RECAPTCHA), found(RECAPTCHA_RENDER))).alias("recaptcha"),
    )

    def told(k: Column) -> Column:
        third = k["turnstile"].isNull() & k["hcaptcha"].isNull() & k["recaptcha"].isNotNull()
        v3 = X.contains_any(html, RECAPTCHA_V3)
        kind = F.when(k["turnstile"].isNotNull(), "turnstile").when(k["hcaptcha"].isNotNull(), "hcaptcha").when(third & v3, "recaptcha_v3").when(third, "recaptcha_v2")
        return F.struct(
            kind.alias("kind"), F.coalesce(k["turnstile"], k["hcaptcha"], k["recaptcha"]).alias("sitekey"), F.when(third & v3, F.coalesce(found(ACTION), F.lit("verify"))).alias("action"),
            F.when(third & X.contains_any(html, ENTERPRISE), F.lit(True)).alias("enterprise"), F.when(third, found(r"""data-s=["']([^"']+)["']""")).alias("s"),
        )

    return X.once(keys, told)

"""The registered queries once more, as SQL for another engine.

Written from the meaning of each job, not from its plan: windows over whole
groups, plain joins and `quantile_cont` are fine at the size of a check.
"""

from __future__ import annotations

from html.entities import html5

GAP = r"[^\p{L}\p{N}]+"
BLANK = r"[\s\x{FEFF}\p{Z}]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URGENT = "['thtion', 'attion', 'ertion']"
PAYMENT = "['thanea', 'onbleea']"
FREE_MAIL = "['mail2.example.com', 'mail5.example.com']"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{GAP}'), lambda w: w <> '')"


def _skill_words(text: str) -> str:
    return (
        rf"regexp_extract_all(regexp_replace(lower({text}), '([\p{{L}}\p{{N}}+#])\.', '\1 ', 'g'), "
        r"'\.?[\p{L}\p{N}][\p{L}\p{N}+#]*')"
    )


def _hits(words: str, condition: str) -> str:
    return f"len(list_filter({words}, lambda w: {condition}))"


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The reference after an ampersand in `p`; names must end in a semicolon here.
_NAMES = ", ".join(
    f"{_quoted(name)}: {_quoted(char)}" for name, char in html5.items() if name.endswith(";")
)
_NAME = "regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')"
_NUMBER = "regexp_extract(p, '^#[0-9]{1,6};')"
_REFERENCE = f"""coalesce(MAP {{{_NAMES}}}[{_NAME}] || p[len({_NAME}) + 1:],
    chr(try_cast({_NUMBER}[2:-2] AS INT)) || p[len({_NUMBER}) + 1:], '&' || p)"""


def _html(html: str) -> str:
    out = html
    for pattern in (
        r"(?is)<script\b[^>]*>.*?</script\s*>",
        r"(?is)<style\b[^>]*>.*?</style\s*>",
        r"(?s)<!--.*?-->",
        r"<[A-Za-z/!][^>]*>",
    ):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    parts = f"str_split({out}, '&')"
    out = f"{parts}[1] || coalesce(array_to_string(list_transform({parts}[2:], lambda p: {_REFERENCE}), ''), '')"
    return _trim(f"regexp_replace({out}, '{BLANK}+', ' ', 'g')")


# name -> (names it builds on, body)
PARTS: dict[str, tuple[list[str], str]] = {
    "limits": (
        [],
        """SELECT o_orderpriority AS peer, quantile_cont(o_totalprice, 0.95) AS pay_limit
           FROM orders GROUP BY 1""",
    ),
    "high_pay": (
        ["limits"],
        """SELECT o_orderkey AS posting_id, peer, o_totalprice AS pay, pay_limit
           FROM orders JOIN limits ON peer = o_orderpriority WHERE o_totalprice > pay_limit""",
    ),
    "doc_words": ([], f"SELECT doc_id, text, {_words('text')} AS words FROM documents"),
    "mails": (
        [],
        f"""SELECT doc_id, list_transform(regexp_extract_all(text, '{EMAIL}'),
                   lambda e: lower(split_part(e, '@', -1))) AS domains FROM documents""",
    ),
    "mail_hits": (
        ["mails"],
        f"""SELECT doc_id, len(domains) AS emails,
                   list_filter(domains, lambda d: list_contains({FREE_MAIL}, d))[1]
                       AS free_mail_domain FROM mails""",
    ),
    "urgency_hits": (
        ["doc_words"],
        f"""SELECT doc_id, {_hits('words', f'list_contains({URGENT}, w)')} AS urgent_words,
                   {_hits(f"regexp_split_to_array(text, '{GAP}')",
                          "regexp_full_match(w, '[\\p{Lu}]{4,}')")} AS caps_words,
                   len(regexp_extract_all(text, '[!?*#%]{{3,}}')) AS punctuation_runs
            FROM doc_words""",
    ),
    "vague_counts": (
        ["doc_words"],
        f"""SELECT doc_id, len(words) AS words, len(list_distinct(words)) AS distinct_words,
                   {_hits('words', "regexp_matches(w, '[\\p{N}]')")} AS number_words FROM doc_words""",
    ),
    "vague_shares": (
        ["vague_counts"],
        """SELECT *, CASE WHEN words > 0 THEN distinct_words / words END AS ds,
                  CASE WHEN words > 0 THEN number_words / words END AS ns FROM vague_counts""",
    ),
    "payment_counts": (
        ["doc_words"],
        f"""SELECT doc_id, {_hits('words', f'list_contains({PAYMENT}, w)')} AS payment_hits
            FROM doc_words""",
    ),
    "signals": (
        ["high_pay", "mail_hits", "urgency_hits", "vague_shares", "payment_counts"],
        """SELECT d.doc_id AS posting_id, h.posting_id IS NOT NULL AS salary,
                  free_mail_domain IS NOT NULL AS email, free_mail_domain,
                  urgent_words + caps_words + punctuation_runs >= 2 AS urgency,
                  coalesce(ds <= 0.55 AND ns <= 0.002, false) AS vague,
                  payment_hits > 0 AS payment
           FROM documents d
           LEFT JOIN high_pay h ON h.posting_id = d.doc_id
           JOIN mail_hits USING (doc_id) JOIN urgency_hits USING (doc_id)
           JOIN vague_shares USING (doc_id) JOIN payment_counts USING (doc_id)""",
    ),
    "flags": (
        ["signals"],
        """SELECT *, list_filter([
                  CASE WHEN salary THEN 'Unusually High Salary Range' END,
                  CASE WHEN email THEN 'Generic Email Domain (@' || free_mail_domain || ')' END,
                  CASE WHEN urgency THEN 'Urgency and Grammatical Errors' END,
                  CASE WHEN vague THEN 'Vague Job Description' END,
                  CASE WHEN payment THEN 'Upfront Payment Request' END],
                  lambda f: f IS NOT NULL) AS flags FROM signals""",
    ),
    "scored": (
        ["flags"],
        """SELECT *, least(100, 35 * salary::INT + 25 * email::INT + 25 * urgency::INT
                  + 10 * vague::INT + 50 * payment::INT)::INT AS score FROM flags""",
    ),
    "banded": (
        ["scored"],
        """SELECT *, CASE WHEN score < 30 THEN 'safe' WHEN score < 70 THEN 'suspicious'
                  ELSE 'high' END AS band FROM scored""",
    ),
    "scam": (
        ["banded"],
        """SELECT *, CASE band WHEN 'high' THEN 'High Risk / Likely Scam'
                  WHEN 'suspicious' THEN 'Suspicious / Review Advised'
                  ELSE 'Low Risk / No Major Red Flags' END AS verdict FROM banded""",
    ),
    "reviews": (
        [],
        """SELECT o_orderkey AS review_id, o_custkey AS company_id,
                  6 - substr(o_orderpriority, 1, 1)::INT AS rating, o_orderdate AS reviewed_at
           FROM orders""",
    ),
    "listings": (
        [],
        """SELECT o_custkey AS company_id, o_orderstatus AS registry FROM orders""",
    ),
    "companies": (
        [],
        """SELECT c_custkey, c_name FROM customer
           UNION ALL SELECT -1 - s_suppkey, s_name FROM supplier""",
    ),
    "age": (
        ["companies"],
        """SELECT company_id, domain_age_days, domain_age_days || ' Days' AS domain_age FROM (
             SELECT c_custkey AS company_id, CASE WHEN days >= 0 THEN days END AS domain_age_days
             FROM companies LEFT JOIN (
               SELECT o_custkey, date_diff('day', min(o_orderdate)::DATE, DATE '1999-01-01') AS days
               FROM orders GROUP BY 1) ON o_custkey = c_custkey)""",
    ),
    "presence": (
        ["listings", "companies"],
        """SELECT *, CASE WHEN registries > 0 THEN 'Listed in ' || registries || ' Registries'
                  ELSE 'Not Found in Major Registries' END AS online_presence FROM (
             SELECT c_custkey AS company_id, count(DISTINCT registry) AS registries
             FROM companies LEFT JOIN listings ON company_id = c_custkey GROUP BY 1)""",
    ),
    "verified": (
        ["age", "presence", "reviews"],
        """SELECT company_id, coalesce(domain_age_days >= 365 AND registries >= 1
                    AND company_id IN (SELECT company_id FROM reviews), false) AS is_verified,
                  domain_age, domain_age_days, online_presence
           FROM age JOIN presence USING (company_id)""",
    ),
    "shown": (
        ["verified"],
        """SELECT company_id, is_verified, coalesce(nullif(domain_age, ''), 'Unknown') AS domain_age,
                  domain_age_days,
                  coalesce(nullif(online_presence, ''), 'N/A') AS online_presence,
                  CASE WHEN is_verified THEN 'Verified Business Entity' ELSE 'Unverified Entity' END
                    AS entity FROM verified""",
    ),
    "ratings": (
        ["reviews", "companies"],
        """SELECT c_custkey AS company_id, count(rating) AS reviews,
                  coalesce(round(avg(rating), 1), 0.0) AS score
           FROM companies LEFT JOIN reviews ON company_id = c_custkey GROUP BY 1""",
    ),
    "sentiments": (
        ["ratings"],
        """SELECT *, CASE WHEN reviews = 0 THEN 'No Data' WHEN score < 2.5 THEN 'Negative'
                  WHEN score < 3.5 THEN 'Mixed' ELSE 'Positive' END AS sentiment FROM ratings""",
    ),
    "review_words": (
        ["reviews", "doc_words"],
        """SELECT review_id, company_id, unnest(words) AS token
           FROM doc_words JOIN reviews ON review_id = doc_id""",
    ),
    "frequency": (
        ["doc_words"],
        """SELECT token, count(*) AS df FROM (
             SELECT doc_id, unnest(list_distinct(words)) AS token FROM doc_words) GROUP BY 1""",
    ),
    "lexicon": (
        ["frequency"],
        """SELECT token, CASE WHEN df * 1000 <= 40 * n THEN 1.0 ELSE -1.0 END AS weight
           FROM frequency, (SELECT count(*) AS n FROM documents)
           WHERE df * 1000 BETWEEN 20 * n AND 80 * n""",
    ),
    "summaries": (
        ["reviews", "companies"],
        """SELECT c_custkey AS company_id,
                  coalesce(text, 'No employee reviews found for this entity.') AS summary
           FROM companies LEFT JOIN (
             SELECT company_id, text, row_number() OVER (PARTITION BY company_id
                      ORDER BY round(abs(rating - mean), 6), review_id) AS rn
             FROM reviews JOIN (SELECT company_id, avg(rating) AS mean FROM reviews GROUP BY 1)
                    USING (company_id)
             JOIN documents ON doc_id = review_id WHERE length(text) > 0)
           ON company_id = c_custkey AND rn = 1""",
    ),
    "terms": (
        ["review_words", "lexicon"],
        """SELECT *, row_number() OVER (PARTITION BY company_id, good ORDER BY n DESC, token) AS rn
           FROM (SELECT company_id, token, weight > 0 AS good, count(*) AS n
                 FROM review_words JOIN lexicon USING (token) GROUP BY 1, 2, 3)""",
    ),
    "pros_cons": (
        ["terms", "companies"],
        """SELECT c_custkey AS company_id,
                  string_agg(token, ', ' ORDER BY rn) FILTER (good AND rn <= 3) AS pros,
                  string_agg(token, ', ' ORDER BY rn) FILTER (NOT good AND rn <= 3) AS cons
           FROM companies LEFT JOIN terms ON company_id = c_custkey GROUP BY 1""",
    ),
    "skills": (
        ["frequency"],
        """SELECT token AS skill FROM frequency, (SELECT count(*) AS n FROM documents)
           WHERE df * 1000 BETWEEN 10 * n AND 12 * n
           UNION SELECT text FROM benchmark""",
    ),
    "skill_tokens": (
        [],
        f"SELECT doc_id, {_skill_words('text')} AS words FROM documents",
    ),
    "skill_words": (
        ["skills"],
        f"""SELECT skill, words, len(words) AS n FROM (SELECT skill, {_skill_words('skill')} AS words FROM skills)
            WHERE len(words) > 0""",
    ),
    "doc_skills": (
        ["skill_tokens", "skill_words"],
        """SELECT DISTINCT doc_id, skill
           FROM (SELECT doc_id, unnest(words) AS word FROM skill_tokens)
           JOIN (SELECT skill, words[1] AS word FROM skill_words WHERE n = 1) USING (word)
           UNION ALL
           SELECT doc_id, skill FROM skill_tokens d JOIN skill_words s ON s.n > 1 AND contains(
             ' ' || array_to_string(d.words, ' ') || ' ', ' ' || array_to_string(s.words, ' ') || ' ')""",
    ),
    "pairs": (
        [],
        """SELECT DISTINCT l_partkey % n AS resume_id, l_orderkey % n AS posting_id
           FROM lineitem, (SELECT count(*) AS n FROM documents)""",
    ),
    "needs": (
        ["pairs", "doc_skills"],
        """SELECT resume_id, posting_id, j.skill, r.skill IS NOT NULL AS held
           FROM pairs JOIN doc_skills j ON j.doc_id = posting_id
           LEFT JOIN doc_skills r ON r.doc_id = resume_id AND r.skill = j.skill""",
    ),
    "matches": (
        ["needs"],
        """SELECT resume_id, posting_id, coalesce(required, 0)::INT AS required,
                  coalesce(shared, 0)::INT AS shared,
                  round(100.0::DOUBLE * shared / required, 2) AS match_percentage,
                  coalesce(missing, '') AS missing
           FROM pairs LEFT JOIN (
             SELECT resume_id, posting_id, count(*) AS required, count(*) FILTER (held) AS shared,
                    string_agg(skill, '; ' ORDER BY skill) FILTER (NOT held) AS missing
             FROM needs GROUP BY 1, 2) USING (resume_id, posting_id)""",
    ),
    "weights": (
        ["doc_words"],
        """SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM (
             SELECT doc_id, term,
                    tf * ln((SELECT count(*) FROM documents)::DOUBLE
                            / count(*) OVER (PARTITION BY term)) AS w
             FROM (SELECT doc_id, term, count(*) AS tf
                   FROM (SELECT doc_id, unnest(words) AS term FROM doc_words) GROUP BY 1, 2))
           WHERE w > 0""",
    ),
    "user_events": (
        [],
        """SELECT event_id, ts, user_id, CASE event_type WHEN 'view' THEN 'scan'
                  WHEN 'purchase' THEN 'verified' ELSE event_type END AS event_type FROM events""",
    ),
    "usage": (
        ["user_events"],
        """SELECT user_id, count(*) FILTER (event_type = 'scan') AS scans,
                  count(*) FILTER (event_type = 'verified') AS verified
           FROM user_events GROUP BY 1""",
    ),
    "subscriptions": (
        [],
        """SELECT DISTINCT user_id,
                  ['Free', 'Pro', 'Enterprise'][user_id % 3 + 1] AS plan,
                  ['monthly', 'yearly'][user_id % 2 + 1] AS billing FROM events""",
    ),
    "changes": (
        [],
        """SELECT user_id, ts AS valid_from,
                  arg_min(plan, CASE plan WHEN 'Free' THEN 'z' ELSE plan END) AS plan
           FROM (SELECT *, ['Free', 'Pro', 'Enterprise'][event_id % 3 + 1] AS plan FROM events
                 WHERE event_type = 'signup') GROUP BY ALL""",
    ),
    "current": (
        ["changes"],
        "SELECT user_id, arg_max(plan, valid_from) AS plan FROM changes GROUP BY 1",
    ),
    # Names, prices and features of the plans, here and below.
    "prices": (
        [],
        """SELECT * FROM (VALUES
             ('Free', false, 'monthly', 0, 0.0), ('Free', false, 'yearly', 0, NULL),
             ('Pro', true, 'monthly', 12, 0.0), ('Pro', true, 'yearly', 9, 25.0),
             ('Enterprise', false, 'monthly', 59, 0.0), ('Enterprise', false, 'yearly', 49, 16.9))
           AS p(plan, popular, billing, price, saving_percent)""",
    ),
    "profile_ops": (
        [],
        """SELECT user_id, event_id AS seq, event_type <> 'error' AS is_add,
                  's' || (json_extract_string(props, '$.k')::INT // 10) AS skill
           FROM events""",
    ),
    "held_skills": (
        ["profile_ops"],
        """SELECT user_id, skill, min(seq) AS seq FROM profile_ops a
           WHERE is_add AND NOT EXISTS (SELECT 1 FROM profile_ops b WHERE NOT b.is_add
             AND b.user_id = a.user_id AND b.skill = a.skill AND b.seq > a.seq)
           GROUP BY 1, 2""",
    ),
    "completion": (
        ["listings"],
        """SELECT c_custkey AS user_id, round(100.0 * (1 + (c_acctbal > 0)::INT
                    + (c_nationkey >= 10)::INT
                    + (c_custkey IN (SELECT company_id FROM listings))::INT) / 4, 2) AS completion
           FROM customer""",
    ),
    "chat": (
        [],
        """SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'bot' ELSE role END AS role, text,
                  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
                  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
           FROM conversations""",
    ),
    "alerts": (
        ["scam"],
        """SELECT posting_id, strftime(o_orderdate, '%Y-%m-%d') AS posted_at, score, band,
                  array_to_string(flags, '; ') AS flags
           FROM scam JOIN orders ON o_orderkey = posting_id WHERE score >= 70""",
    ),
    "told": (
        ["alerts", "subscriptions"],
        """SELECT DISTINCT e.user_id, posting_id, posted_at, score, band, flags
           FROM alerts JOIN orders ON o_orderkey = posting_id
           JOIN events e ON e.event_id % (SELECT count(*) FROM customer) + 1 = o_custkey
           JOIN subscriptions s ON s.user_id = e.user_id AND plan <> 'Free'""",
    ),
    "text_windows": (
        ["doc_words", "lexicon", "reviews"],
        """SELECT to_timestamp(w * 2592000)::TIMESTAMP AS ws, company_id, count(*) AS texts,
                  sum(n)::BIGINT AS lexicon_words, round(sum(s) / sum(n), 4) AS text_score
           FROM (SELECT *, floor(epoch(reviewed_at) / 2592000) AS w FROM reviews)
           JOIN (SELECT doc_id AS review_id, count(*) AS n, sum(weight::DOUBLE) AS s
                 FROM (SELECT doc_id, unnest(words) AS token FROM doc_words) JOIN lexicon USING (token)
                 WHERE doc_id % 3 < 2 GROUP BY 1) USING (review_id)
           GROUP BY w, 2""",
    ),
    "entries": (
        ["lexicon", "skills"],
        f"""SELECT *, {_words('entry')} AS ew FROM (
              SELECT 'urgent' AS list, token AS entry FROM lexicon WHERE weight < 0
              UNION SELECT 'payment', skill FROM skills)""",
    ),
    "windows": (
        ["reviews"],
        """SELECT to_timestamp(w * 2592000)::TIMESTAMP AS ws, company_id, count(*) AS reviews,
                  round(avg(rating), 4) AS mean_rating
           FROM (SELECT *, floor(epoch(reviewed_at) / 2592000) AS w FROM reviews) GROUP BY w, 2""",
    ),
    "sessions": (
        [],
        """SELECT user_id, min(ts) AS s, max(ts) + INTERVAL 4 HOUR AS e, count(*) AS events FROM (
             SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
             FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                          <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
           GROUP BY user_id, n""",
    ),
}


def _sql(needs: list[str], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for below in PARTS[name][0]:
            visit(below)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    # Parts may carry the name of a test table; none is read after being shadowed.
    head = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n][1]})" for n in ordered)
    return f"WITH {head}\n{body}" if head else body


_SESSION = (
    "SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS session_start, "
    "strftime(e, '%Y-%m-%d %H:%M:%S') AS session_end, events FROM sessions"
)
_WINDOW = (
    "SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, "
    "strftime(ws + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, "
    "company_id, reviews, mean_rating FROM windows"
)
_TEXT_WINDOW = (
    "SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, "
    "strftime(ws + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, company_id, texts, lexicon_words, "
    "text_score, CASE WHEN text_score < 0 THEN 'Negative' WHEN text_score > 0 THEN 'Positive' ELSE 'Mixed' END "
    "AS sentiment FROM text_windows"
)
_PHONE = r"\+?[0-9](?:[ ().-]{0,2}[0-9]){6,}"



def _masked(text: str) -> str:
    return (
        f"regexp_replace(regexp_replace({text}, '{EMAIL}', '[email]', 'g'), "
        f"'(^|[^0-9A-Za-z+]){_PHONE}($|[^0-9A-Za-z])', '\\1[phone]\\2', 'g')"
    )


# All that is handed in, pages under ids below 0; the rules are those of the documents.
_HANDED = f"""SELECT doc_id, CASE WHEN lang = 'es' THEN '' ELSE text END AS text,
       CASE WHEN source < 'src15' THEN doc_id || '.pdf' END AS file_name FROM documents
     UNION ALL SELECT -1 - page_id, {_html('html')}, NULL FROM pages"""
_ANALYZED = _sql(["scam"], f"""
    SELECT CASE WHEN doc_id < 0 THEN 'url' ELSE 'pasted' END AS origin,
           CASE WHEN doc_id < 0 THEN -1 - doc_id ELSE doc_id END AS id,
           origin || ':' || id AS posting_key, file_name, {_masked('text')} AS text,
           array_to_string(flags, '; ') AS flags, score, band, verdict
    FROM scam JOIN documents ON doc_id = posting_id
    WHERE length(text) > 0 OR file_name IS NOT NULL""").replace("documents", "handed")

ORACLES: dict[str, str] = {
    "analyze_path": f"WITH handed AS MATERIALIZED ({_HANDED}),\n" + _ANALYZED.removeprefix("WITH "),
    "collect_postings": _sql([], f"""
        SELECT 'pasted' AS origin, doc_id AS id, text FROM documents
        UNION ALL SELECT 'url', page_id, {_html('html')} FROM pages"""),
    "page_text": _sql([], f"SELECT page_id, {_html('html')} AS text FROM pages"),
    "posting_hosts": _sql([], r"""
        SELECT page_id, regexp_extract(url, '^([^:]+)://', 1) AS scheme,
               regexp_extract(url, '^[^:]+://([^/?#:]+)', 1) AS host,
               regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM pages"""),
    "submission_gate": _sql([], """
        SELECT * FROM (
          SELECT doc_id AS posting_id, CASE WHEN lang = 'es' THEN '' ELSE text END AS text,
                 CASE WHEN source < 'src15' THEN doc_id || '.pdf' END AS file_name,
                 n_chars::BIGINT AS file_bytes,
                 round(n_chars::DOUBLE / 1024 / 1024, 2) AS size_mb FROM documents)
        WHERE length(text) > 0 OR file_name IS NOT NULL"""),
    "write_report": _sql(["scam"], "SELECT posting_id, score, band, verdict FROM scam"),
    "salary_limits": _sql(["limits"], "SELECT peer, round(pay_limit, 4) AS pay_limit FROM limits"),
    "salary_outliers": _sql(["high_pay"], """
        SELECT posting_id, peer, pay, round(pay_limit, 4) AS pay_limit FROM high_pay"""),
    "generic_email_flags": _sql(["mail_hits"], """
        SELECT doc_id AS posting_id, emails::INT AS emails, free_mail_domain,
               free_mail_domain IS NOT NULL AS generic_email FROM mail_hits WHERE emails > 0"""),
    "urgency_flags": _sql(["urgency_hits"], """
        SELECT doc_id AS posting_id, urgent_words::INT AS urgent_words,
               caps_words::INT AS caps_words, punctuation_runs::INT AS punctuation_runs,
               urgent_words + caps_words + punctuation_runs >= 2 AS urgency FROM urgency_hits"""),
    "vague_language": _sql(["vague_shares"], """
        SELECT doc_id AS posting_id, words::INT AS words, distinct_words::INT AS distinct_words,
               number_words::INT AS number_words, round(ds, 4) AS distinct_share,
               round(ns, 4) AS number_share, coalesce(ds <= 0.55 AND ns <= 0.002, false) AS vague
        FROM vague_shares"""),
    "upfront_payment_flags": _sql(["payment_counts"], """
        SELECT doc_id AS posting_id, payment_hits::INT AS payment_hits FROM payment_counts
        WHERE payment_hits > 0"""),
    "exact_reposts": _sql(["doc_words"], """
        SELECT sha256(array_to_string(words, ' ')) AS text_key, min(doc_id) AS first_posting,
               count(*) AS postings, count(DISTINCT source) AS sources
        FROM doc_words JOIN documents USING (doc_id) WHERE len(words) > 0 GROUP BY 1 HAVING count(*) > 1"""),
    "scam_flags": _sql(["flags"], """
        SELECT posting_id, salary, email, urgency, vague, payment,
               array_to_string(flags, '; ') AS flags FROM flags"""),
    "risk_score": _sql(["scored"], "SELECT posting_id, score FROM scored"),
    "risk_band": _sql(["banded"], "SELECT posting_id, score, band FROM banded"),
    "verdict_label": _sql(["scam"], "SELECT posting_id, score, band, verdict FROM scam"),
    "flag_rows": _sql(["flags"], """
        SELECT posting_id, (unnest(range(len(flags))))::INT AS pos, unnest(flags) AS flag
        FROM flags"""),
    "domain_age": _sql(["age"], """
        SELECT company_id, domain_age_days::DOUBLE AS domain_age_days, domain_age FROM age"""),
    "online_presence": _sql(["presence"], "SELECT * FROM presence"),
    "unlisted_companies": _sql(["listings", "companies"], """
        SELECT c_custkey AS company_id, c_name AS name FROM companies
        WHERE c_custkey NOT IN (SELECT company_id FROM listings)"""),
    "listed_companies": _sql(["listings", "companies"], """
        SELECT c_custkey AS company_id, c_name AS name FROM companies
        WHERE c_custkey IN (SELECT company_id FROM listings)"""),
    "verify_company": _sql(["verified"], """
        SELECT company_id, is_verified, domain_age, domain_age_days::DOUBLE AS domain_age_days,
               online_presence FROM verified"""),
    "verification_defaults": _sql(["shown"], """
        SELECT company_id, is_verified, domain_age, domain_age_days::DOUBLE AS domain_age_days,
               online_presence, entity FROM shown"""),
    "company_deep_dive": _sql(["scam", "reviews"], """
        SELECT p.*, mean_rating FROM (
          SELECT o_custkey AS company_id, count(*) AS postings, round(avg(score), 4) AS mean_score,
                 max(score) AS max_score,
                 round((count(*) FILTER (band = 'high'))::DOUBLE / count(*), 4) AS high_share,
                 strftime(min(o_orderdate), '%Y-%m-%d') AS first_posting,
                 strftime(max(o_orderdate), '%Y-%m-%d') AS last_posting
          FROM scam JOIN orders ON o_orderkey = posting_id GROUP BY 1) p
        LEFT JOIN (SELECT company_id, round(avg(rating), 4) AS mean_rating FROM reviews GROUP BY 1)
          USING (company_id)"""),
    "review_scores": _sql(["ratings"], "SELECT * FROM ratings"),
    "sentiment_label": _sql(["sentiments"], "SELECT * FROM sentiments"),
    "review_lexicon_sentiment": _sql(["doc_words", "lexicon"], """
        SELECT review_id, coalesce(n, 0) AS lexicon_words, coalesce(round(mean, 4), 0.0) AS text_score
        FROM (SELECT doc_id AS review_id FROM documents)
        LEFT JOIN (SELECT doc_id AS review_id, count(*) AS n, avg(weight::DOUBLE) AS mean
                   FROM (SELECT doc_id, unnest(words) AS token FROM doc_words) JOIN lexicon USING (token) GROUP BY 1) USING (review_id)"""),
    "review_summary": _sql(["summaries"], "SELECT * FROM summaries"),
    "pros_cons": _sql(["pros_cons"], "SELECT * FROM pros_cons"),
    "extract_skills": _sql(["doc_skills"], "SELECT * FROM doc_skills"),
    "match_percentage": _sql(["matches"], """
        SELECT resume_id, posting_id, required, shared, match_percentage FROM matches"""),
    "missing_skills": _sql(["needs"], """
        SELECT resume_id, posting_id, skill FROM needs WHERE NOT held"""),
    "keyword_suggestions": _sql(["needs"], """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id
                                ORDER BY jobs DESC, skill)::INT AS rank
          FROM (SELECT resume_id, skill, count(*) AS jobs FROM needs WHERE NOT held GROUP BY 1, 2))
        WHERE rank <= 5"""),
    "best_jobs": _sql(["matches"], """
        SELECT * FROM (SELECT resume_id, posting_id, match_percentage, row_number() OVER (
                 PARTITION BY resume_id ORDER BY match_percentage DESC, posting_id)::INT AS rank
          FROM matches WHERE match_percentage IS NOT NULL) WHERE rank <= 2"""),
    "text_similarity": _sql(["pairs", "weights"], """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id
                                ORDER BY cosine DESC, posting_id)::INT AS rank
          FROM (SELECT resume_id, posting_id, round(coalesce(dot, 0.0), 4) AS cosine
                FROM pairs LEFT JOIN (
                  SELECT resume_id, posting_id, sum(p.weight * r.weight) AS dot
                  FROM pairs JOIN weights p ON p.doc_id = posting_id
                  JOIN weights r ON r.doc_id = resume_id AND r.term = p.term GROUP BY 1, 2)
                USING (resume_id, posting_id))) WHERE rank <= 2"""),
    "vector_match": _sql(["pairs"], """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resume_id
                                ORDER BY cosine DESC NULLS LAST, posting_id)::INT AS rank
          FROM (SELECT resume_id, posting_id,
                       round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)
                         AS cosine
                FROM pairs LEFT JOIN embeddings a ON a.vec_id = resume_id
                LEFT JOIN embeddings b ON b.vec_id = posting_id)) WHERE rank <= 5"""),
    "profile_skills": _sql(["held_skills"], """
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seq) - 1 AS pos, skill
        FROM held_skills"""),
    "profile_completion": _sql(["completion"], "SELECT * FROM completion"),
    "profile_card": _sql(["completion", "usage", "held_skills"], """
        SELECT user_id, rank::DOUBLE AS rank, coalesce(completion, 0.0) AS completion,
               coalesce(scans, 0) AS scans, coalesce(verified, 0) AS verified,
               coalesce(skills, 0) AS skills
        FROM completion FULL JOIN (SELECT *, rank() OVER (ORDER BY scans DESC) AS rank FROM usage)
          USING (user_id)
        LEFT JOIN (SELECT user_id, count(*) AS skills FROM held_skills GROUP BY 1) USING (user_id)"""),
    "user_usage": _sql(["usage"], "SELECT * FROM usage"),
    "user_rank": _sql(["usage"], """
        SELECT user_id, scans, rank() OVER (ORDER BY scans DESC) AS rank FROM usage"""),
    "scan_quota": _sql(["user_events", "subscriptions"], """
        SELECT event_id, user_id, month, plan, plan <> 'Free' OR rn <= 3 AS allowed FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, month ORDER BY ts, event_id) AS rn
          FROM (SELECT *, strftime(ts, '%Y-%m') AS month FROM user_events
                WHERE event_type = 'scan')) JOIN subscriptions USING (user_id)"""),
    "limited_history": _sql(["user_events", "subscriptions"], """
        SELECT user_id, event_id, event_type, CASE WHEN plan = 'Free' THEN rank END AS rank
        FROM (SELECT *, row_number() OVER (
                 PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::DOUBLE AS rank
          FROM user_events) JOIN subscriptions USING (user_id) WHERE plan <> 'Free' OR rank <= 10"""),
    "plan_at": _sql(["user_events", "changes"], """
        SELECT event_id, e.user_id, plan FROM user_events e
        ASOF LEFT JOIN changes c ON c.user_id = e.user_id AND e.ts >= c.valid_from"""),
    "scan_quota_history": _sql(["user_events", "changes"], """
        SELECT event_id, e.user_id, month, plan,
               plan IS NOT NULL AND (plan <> 'Free' OR rn <= 3) AS allowed
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, month ORDER BY ts, event_id) AS rn
              FROM (SELECT *, strftime(ts, '%Y-%m') AS month FROM user_events
                    WHERE event_type = 'scan')) e
        ASOF LEFT JOIN changes c ON c.user_id = e.user_id AND e.ts >= c.valid_from"""),
    "limited_history_now": _sql(["user_events", "current"], """
        SELECT user_id, event_id, event_type,
               CASE WHEN coalesce(plan, 'Free') = 'Free' THEN rank END AS rank
        FROM (SELECT *, row_number() OVER (
                 PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::DOUBLE AS rank
          FROM user_events) LEFT JOIN current USING (user_id)
        WHERE coalesce(plan, 'Free') <> 'Free' OR rank <= 10"""),
    "plan_prices": _sql(["prices", "subscriptions"], """
        SELECT p.plan, popular, p.billing, price, saving_percent::DOUBLE AS saving_percent,
               count(user_id) AS subscribers
        FROM prices p LEFT JOIN subscriptions s ON s.plan = p.plan AND s.billing = p.billing
        GROUP BY ALL"""),
    "plan_features": _sql(["subscriptions"], """
        SELECT f.plan, pos, feature, count(user_id) AS subscribers
        FROM (VALUES
          ('Free', 0, '3 Resume Scans per month'), ('Free', 1, 'Basic Scam Detection'),
          ('Free', 2, 'Community Support'), ('Free', 3, 'Limited Job History'),
          ('Pro', 0, 'Unlimited Resume Scans'), ('Pro', 1, 'Advanced AI Matching'),
          ('Pro', 2, 'Priority Scam Alerts'), ('Pro', 3, 'Company Deep Dive'),
          ('Pro', 4, '24/7 Support'), ('Enterprise', 0, 'Bulk Analysis API'),
          ('Enterprise', 1, 'Team Dashboard'), ('Enterprise', 2, 'Custom Integrations'),
          ('Enterprise', 3, 'Dedicated Account Manager'), ('Enterprise', 4, 'SLA Support'))
          AS f(plan, pos, feature) LEFT JOIN subscriptions s ON s.plan = f.plan GROUP BY ALL"""),
    "subscription_charges": _sql(["prices", "subscriptions"], """
        SELECT user_id, plan, billing, price AS charge
        FROM subscriptions JOIN prices USING (plan, billing)"""),
    "charge_totals": _sql(["prices", "subscriptions"], """
        SELECT plan, billing, count(*) AS users, sum(price)::BIGINT AS total
        FROM subscriptions JOIN prices USING (plan, billing) GROUP BY ALL"""),
    "team_dashboard": _sql(["scam"], """
        SELECT source AS team, band, grouping(source, band)::INT AS level, count(*) AS postings,
               round(avg(score), 4) AS mean_score
        FROM scam JOIN documents ON doc_id = posting_id GROUP BY ROLLUP (source, band)"""),
    "purge_records": _sql(["user_events"], """
        SELECT event_id, user_id, event_type FROM user_events
        WHERE ts >= TIMESTAMP '2024-01-10' AND user_id NOT IN (
          SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)"""),
    "redact_text": _sql([], f"SELECT doc_id, {_masked('text')} AS text FROM documents"),
    "chat_clean": _sql(["chat"], f"""
        SELECT conv_id, turn, role, text FROM chat WHERE length({_trim('text')}) > 0"""),
    "chat_turn_pairs": _sql(["chat"], """
        SELECT conv_id, turn, text, CASE WHEN next_role = 'assistant' THEN next_text END AS reply
        FROM chat WHERE role = 'user'"""),
    "chat_summary": _sql(["chat"], """
        SELECT conv_id, count(*) FILTER (role = 'user') AS user_messages,
               count(*) FILTER (role = 'bot') AS bot_messages,
               count(*) FILTER (role = 'system') AS system_messages,
               count(*) FILTER (role NOT IN ('user', 'bot', 'system')) AS other_messages,
               round((count(*) FILTER (role = 'user' AND next_role IS DISTINCT FROM 'assistant'))::DOUBLE
                     / nullif(count(*) FILTER (role = 'user'), 0), 4) AS unanswered_share
        FROM chat GROUP BY 1"""),
    "analysis_report": _sql(
        ["scam", "shown", "sentiments", "summaries", "pros_cons", "matches"], """
        SELECT p.posting_id, resume_id::DOUBLE AS resume_id, o_custkey AS company_id, band, verdict, p.score AS risk_score,
               array_to_string(flags, '; ') AS flags, is_verified, domain_age,
               domain_age_days::DOUBLE AS domain_age_days, online_presence, sentiment,
               s.score AS review_score, summary, pros, cons, match_percentage,
               coalesce(missing, '') AS missing_skills
        FROM scam p JOIN orders ON o_orderkey = p.posting_id
        LEFT JOIN shown v ON v.company_id = o_custkey
        LEFT JOIN sentiments s ON s.company_id = o_custkey
        LEFT JOIN summaries t ON t.company_id = o_custkey
        LEFT JOIN pros_cons c ON c.company_id = o_custkey
        LEFT JOIN matches m ON m.posting_id = p.posting_id"""),
    "scam_alerts_batch": _sql(["alerts"], "SELECT * FROM alerts"),
    "scam_alerts_stream": _sql(["alerts"], "SELECT * FROM alerts"),
    "plan_alerts_batch": _sql(["told"], "SELECT * FROM told"),
    "plan_alerts_stream": _sql(["told"], "SELECT * FROM told"),
    "text_reputation_batch": _sql(["text_windows"], _TEXT_WINDOW),
    "text_reputation_stream": _sql(["text_windows"], _TEXT_WINDOW + """
        WHERE ws + INTERVAL 30 DAY <= (
          SELECT least(max(o_orderdate), max(CASE WHEN doc_id IS NOT NULL THEN o_orderdate + INTERVAL 1 DAY * (doc_id % 3) END))
                 - INTERVAL 1 DAY
          FROM orders LEFT JOIN documents ON doc_id = o_orderkey)"""),
    "purge_stored": _sql(["user_events"], """
        SELECT event_id, user_id, event_type FROM user_events
        WHERE ts >= TIMESTAMP '2024-01-10' AND user_id NOT IN (
          SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)"""),
    "ml_fold_counts": """
        SELECT (('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT % 3)::INT AS fold, count(*) AS postings,
               count(toxic) AS labelled, count(*) FILTER (WHERE toxic > 0) AS positive
        FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id)
        WHERE text IS NOT NULL GROUP BY 1""",
    "listed_mail_flags": """
        SELECT posting_id, emails::INT AS emails, free_mail_domain, free_mail_domain IS NOT NULL AS generic_email
        FROM (SELECT doc_id AS posting_id, len(domains) AS emails, list_filter(domains,
                     lambda d: try_cast(regexp_extract(d, '[0-9]+') AS INT) %% 2 = 0)[1] AS free_mail_domain
              FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '%s'),
                           lambda e: lower(split_part(e, '@', -1))) AS domains FROM documents))
        WHERE emails > 0""" % EMAIL,
    "listed_phrase_hits": _sql(["doc_words", "entries"], """
        SELECT doc_id AS posting_id, list, count(*) AS hits
        FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM doc_words)
        JOIN entries ON words[i] = ew[1] WHERE words[i:i + len(ew) - 1] = ew GROUP BY ALL"""),
    "reputation_tumbling": _sql(["windows"], _WINDOW),
    "reputation_sliding": _sql(["reviews"], """
        SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
               strftime(ws + INTERVAL 60 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, company_id,
               count(*) AS reviews, round(avg(rating), 4) AS mean_rating
        FROM (SELECT *, to_timestamp((floor(epoch(reviewed_at) / 2592000) - unnest([0, 1]))
                                     * 2592000)::TIMESTAMP AS ws FROM reviews) GROUP BY ws, company_id"""),
    "reputation_stream": _sql(["windows"], _WINDOW + """
        WHERE ws + INTERVAL 30 DAY <= (SELECT max(reviewed_at) - INTERVAL 1 DAY FROM reviews)"""),
    "usage_sessions": _sql(["sessions"], _SESSION),
    "usage_sessions_stream": _sql(["sessions"], _SESSION + """
        WHERE e <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""),
}

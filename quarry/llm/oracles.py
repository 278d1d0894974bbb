"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import re

from . import licences, urls

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"

NEAR_COPIES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER},'{WORD}') AS ws FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(ws)>1 THEN list_distinct(list_transform(range(1,len(ws)), lambda i: ws[i]||' '||ws[i+1])) ELSE ws END AS sh FROM w),
 e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
 p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON a.x=b.x AND a.doc_id<b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100*count(*)>=80*(a.n+b.n-count(*))),
 u AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
 r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.j FROM r JOIN u ON u.i=r.b)
 SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c AS component_id, s.doc_id=c AS kept FROM s JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY 1) USING (doc_id)"""

SAID = "</s>[INST] ok [/INST]"
ESCAPED = r"length({0})+len(regexp_extract_all({0},'\\|<s>|</s>|<<SYS>>|<</SYS>>|\[/?(?:INST|ROLE)\]'))"
CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1,0,'user','{SAID}'),(-1,1,'assistant','{SAID}')) v),
 g AS (SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 20+{ESCAPED.format('role')} END + {ESCAPED.format('text')} AS n FROM c),
 o AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM g)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role||chr(10)||text||chr(10),'' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role='assistant'),0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text,'' ORDER BY turn, role, text) FILTER (role='assistant'),'')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars, count(*) FILTER (role='assistant') AS n_examples, coalesce(sum(upto) FILTER (role='assistant'),0)::BIGINT AS example_chars FROM o GROUP BY 1"""

REPEATS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text,''),'{WORD}') AS ws FROM documents),
 win AS (SELECT doc_id, unnest(x) AS h, generate_subscripts(x,1) AS s FROM (SELECT doc_id, list_transform(range(1,len(ws)-48), lambda s: md5(array_to_string(ws[s:s+49],' '))) AS x FROM w WHERE len(ws)>=50)),
 m AS (SELECT h, min(doc_id) AS d FROM win GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, s+k AS p FROM (SELECT win.doc_id, s FROM win JOIN m USING (h) WHERE d<win.doc_id), (SELECT unnest(range(0,50)) AS k)),
 each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws,1) AS p FROM w),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(word,' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
 SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws)-coalesce(n,0))::BIGINT AS n_removed, sha256(coalesce(t,'')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


FREQUENT_LINES = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text,''),chr(10)) AS ls, row_number() OVER () AS r FROM documents),
 l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls,1) AS p FROM d),
 k AS (SELECT *, translate(trim(line,' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS key FROM l),
 f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key)>=40 GROUP BY 1 HAVING count(DISTINCT doc_id)>=5)
 SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(doc_id<last,false)) AS n_dropped,
 sha256(coalesce(string_agg(line,chr(10) ORDER BY p) FILTER (NOT coalesce(doc_id<last,false)),'')) AS kept_sha256 FROM k LEFT JOIN f USING (key) GROUP BY r"""

def _spelling() -> str:
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    near = "SELECT a.word AS word, b.word AS near, b.n AS near_n FROM {0} AND a.word<>b.word"
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, {LOWER.replace("text,", "t,")} AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text,''),'[A-Za-zÀ-ÿ]+')) AS t FROM documents) GROUP BY 1,2),
 bytes AS (SELECT *, flatten(list_transform(string_split(doc_id||':'||run,''), lambda c: CASE WHEN unicode(c)<128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT,unicode(c)-64] END)) AS b FROM runs WHERE length(run)>=5),
 hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT,b), lambda c, x: xor(c>>8,{table}[(xor(c,x)&255)+1])),4294967295) AS h FROM bytes),
 typed AS (SELECT CASE WHEN h%97=0 THEN substr(run,1,h%length(run))||substr(run,h%length(run)+2) ELSE run END AS word, n FROM hashed),
 v AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word)>=5 GROUP BY 1 HAVING sum(n)>=3),
 cut AS (SELECT word, n, i, substr(word,1,i)||substr(word,i+2) AS less FROM (SELECT word, n, unnest(range(0,length(word))) AS i FROM v)),
 pairs AS (SELECT DISTINCT * FROM ({near.format("cut a JOIN cut b ON a.less=b.less AND a.i=b.i")} UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.less=b.word UNION ALL SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.less=b.word)),
 best AS (SELECT word, count(*) AS n_near, max(near_n) AS form_n FROM pairs GROUP BY 1),
 forms AS (SELECT v.word, v.n, coalesce(n_near,0) AS n_near, CASE WHEN best.form_n>=2*v.n THEN best.form_n END AS form_n FROM v LEFT JOIN best USING (word)),
 f AS (SELECT forms.*, form FROM forms LEFT JOIN (SELECT word, near_n AS form_n, min(near) AS form FROM pairs GROUP BY 1,2) USING (word, form_n)),
 up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, up.next, f.form FROM up JOIN f ON f.word=up.next)
 SELECT f.word, form, root, n, n_near, form_n FROM f JOIN up ON up.word=f.word AND next IS NULL"""


def _pattern(line: str) -> str:
    """The regular expression of a pattern rule, character by character."""
    body = line.removeprefix("@@").lower()
    start = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?" if body.startswith("||") else ""
    return start + "".join({"^": "(?:[^a-z0-9]|^|$)", "*": ".*"}.get(c) or re.escape(c) for c in body.removeprefix("||"))


def _urls() -> str:
    sites = ",".join(f"('{h}','{p}','{v}')" for h, p, v in urls.SITE_RULES)
    patterns = ",".join(f"('{_pattern(p)}','{'allow' if p.startswith('@@') else 'block'}')" for p in urls.PATTERN_RULES)
    return f"""WITH u AS (SELECT page_id, coalesce(url,'') AS url, instr(coalesce(url,''),'://') AS k FROM pages),
 x AS (SELECT page_id, url, CASE WHEN k>0 THEN translate(regexp_extract(substr(url,k+3),'^[^/?#]*'),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host, CASE WHEN k>0 THEN regexp_extract(substr(url,k+3),'^[^/?#]*([^?#]*)',1) ELSE '' END AS path FROM u),
 site AS (SELECT page_id, url, arg_max(concat(h,p),length(h)+length(p)) AS rule, arg_max(v,length(h)+length(p)) AS verdict FROM x JOIN (VALUES {sites}) r(h,p,v) ON (host=h OR ends_with(host,'.'||h)) AND starts_with(path,p) GROUP BY 1,2),
 pat AS (SELECT page_id, url, bool_or(v='block') AND NOT bool_or(v='allow') AS blocked FROM x JOIN (VALUES {patterns}) r(re,v) ON regexp_matches(lower(url),re,'s') GROUP BY 1,2)
 SELECT x.page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict FROM x LEFT JOIN site USING (page_id, url) LEFT JOIN pat USING (page_id, url)"""


def _licences() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    forms = ",".join(f"({i},'{licence}',{quoted(text)},{full})" for i, (licence, text, full) in enumerate(licences.templates()))
    low = "translate({0},'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    found = lambda x: f"unnest(regexp_extract_all({low.format(x)},'{licences.TERM}'))"
    return f"""WITH f(form,licence,body,full_text) AS (VALUES {forms}),
 d AS (SELECT doc_id, source||'/'||lang||'/'||doc_id||'.txt' AS path, source||'/'||lang AS directory, coalesce(text,'') AS text FROM documents),
 df AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, {found('text')} AS term FROM d) GROUP BY 1),
 ft AS (SELECT form, licence, full_text, term, count(*) AS tf FROM (SELECT form, licence, full_text, {found('body')} AS term FROM f) GROUP BY 1,2,3,4),
 p AS (SELECT doc_id, 0 AS part, text AS body FROM d WHERE regexp_matches(text,'{licences.LICENCE_WORDS}') UNION ALL
  SELECT doc_id, 1, regexp_extract(text,'{licences.HEAD}+') FROM d WHERE regexp_matches(text,'{licences.LICENCE_WORDS}') UNION ALL
  SELECT doc_id, 1+row_number() OVER (PARTITION BY doc_id ORDER BY body), body FROM (SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(text,'{licences.RUN}+'), string_split(text,chr(10)))) AS body FROM d WHERE regexp_matches(text,'{licences.LICENCE_WORDS}')) WHERE regexp_matches(body,'{licences.LICENCE_WORDS}')),
 c AS (SELECT doc_id, part, term, count(*) AS tf FROM (SELECT doc_id, part, {found('body')} AS term FROM p) GROUP BY 1,2,3),
 idf AS (SELECT term, 1-ln(coalesce(n,0)::DOUBLE/(SELECT count(*) FROM d)+{licences.RARE}) AS idf FROM (SELECT term FROM c UNION SELECT term FROM ft) LEFT JOIN df USING (term)),
 tw AS (SELECT form, licence, full_text, term, tf*idf/sqrt(sum((tf*idf)*(tf*idf)) OVER (PARTITION BY form)) AS weight FROM ft JOIN idf USING (term)),
 v AS (SELECT doc_id, part, term, tf*idf AS w FROM c JOIN idf USING (term)),
 s AS (SELECT doc_id, part, form, licence, full_text, sum(w*weight) AS dot FROM v JOIN tw USING (term) WHERE part<2 OR NOT full_text GROUP BY 1,2,3,4,5),
 k AS (SELECT s.doc_id, licence, round(dot/norm,6) AS cosine, CASE WHEN full_text THEN 0 ELSE 2 END AS rank, part=0 AS whole FROM s JOIN (SELECT doc_id, part, sqrt(sum(w*w)) AS norm FROM v GROUP BY 1,2) USING (doc_id, part) WHERE round(dot/norm,6)>=CASE WHEN full_text THEN {licences.WHOLE} ELSE {licences.LEAST} END
  UNION ALL SELECT doc_id, {low.format(f"regexp_extract(text,'{licences.SPDX}',1)")}, 1.0, 1, false FROM d WHERE regexp_matches(text,'{licences.SPDX}')),
 own AS (SELECT doc_id, licence, cosine, bool_or(whole) OVER (PARTITION BY doc_id) AS whole, row_number() OVER (PARTITION BY doc_id ORDER BY rank, cosine DESC, licence) AS r FROM k),
 given AS (SELECT directory AS gd, licence AS gl, cosine AS gc, row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, doc_id) AS gr FROM own JOIN d USING (doc_id) WHERE r=1 AND (whole OR regexp_matches(path,'{licences.NAME}'))),
 near AS (SELECT doc_id, gl, gc, row_number() OVER (PARTITION BY doc_id ORDER BY length(gd) DESC) AS n FROM d JOIN given ON gr=1 AND (directory=gd OR starts_with(directory, gd||'/') OR gd=''))
 SELECT d.doc_id, path, coalesce(licence,gl) AS licence, coalesce(cosine,gc) AS cosine, CASE WHEN licence IS NOT NULL THEN 'own' WHEN gl IS NOT NULL THEN 'inherited' ELSE 'none' END AS found FROM d LEFT JOIN (SELECT * FROM own WHERE r=1) USING (doc_id) LEFT JOIN (SELECT * FROM near WHERE n=1) USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op4_license_scans": _licences(),
    "op5_minhash_near_dedup": NEAR_COPIES,
    "op6_chat_formatting": CHAT,
    "op8_substring_dedup": REPEATS,
    "op9_url_filters": _urls(),
    "op11_spelling_variants": _spelling(),
    "op12_line_dedup": FREQUENT_LINES,
}

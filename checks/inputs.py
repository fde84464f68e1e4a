"""Inputs derived from the test tables, as SQL both engines read the same way.

The tables hold no amounts, speeds, footnotes or sections, so each input adds
some to every row; no input leaves rows out.
"""

CLEAN = r"""
select doc_id, concat(chr(10), replace(replace(text, '. ',
  concat('. ', chr(160), chr(10), ' ', chr(10), chr(9))), ',', '@BRK#')) as t
from documents"""

MONEY = r"""
select o_orderkey, concat('Paid $', case o_orderkey % 7
  when 0 then '1'
  when 1 then concat(cast(1 + o_orderkey % 9 as varchar(20)), '.25 million')
  when 2 then concat(cast(cast(floor(o_totalprice) as bigint) as varchar(20)), chr(160), 'billion')
  when 3 then concat(cast(cast(floor(o_totalprice / 1000) as bigint) as varchar(20)), ',000 in all')
  when 4 then '0.5 million'
  when 5 then concat('1', chr(10))
  else concat('20', chr(160), 'trillion, then $1') end) as t
from orders"""

SPEED = r"""
select p_partkey, concat('ran ', cast(p_size as varchar(20)), case p_partkey % 8
  when 0 then ' kph'
  when 1 then ' k.p.h. The end'
  when 2 then concat(' k.p.h.', chr(10), 'x')
  when 3 then ' k.p.h. then m.p.h.'
  when 4 then ' mph or kph'
  when 5 then concat(' m.p.h.', chr(160), 'Then')
  when 6 then concat(' m.p.h.', chr(10))
  else ' m.p.h. and' end) as t
from part"""

# Documents as chapters: one book per source.
FOLDER = "case doc_id % 3 when 0 then '' when 1 then 'text/' else 'OEBPS/part/' end"
SPINE = f"""
select source as book_id, doc_id, concat('d', cast(doc_id as varchar(20))) as idref,
  concat({FOLDER}, cast(doc_id as varchar(20)), '.xhtml') as path
from documents"""

TOC = f"""
select d.source as book_id, l.doc_id as pos,
  concat('../', {FOLDER.replace("doc_id", "l.doc_id")}, cast(l.doc_id as varchar(20)), '.xhtml#a') as content,
  case l.doc_id % 4 when 0 then 'Ⅰ' when 1 then 'ab'
  when 2 then concat('Part ', cast(l.doc_id as varchar(20)), ': end', chr(10))
  else concat('Chapter ', cast(l.doc_id as varchar(20)), ': q', cast(l.quality as varchar(20))) end
  as label
from labels l join documents d on l.doc_id = d.doc_id"""

RESOURCES = """
select d.source as book_id, concat('d', cast(l.doc_id as varchar(20))) as idref,
  concat('OEBPS/', cast(l.doc_id as varchar(20)), '.xhtml') as path,
  'application/xhtml+xml' as mime
from labels l join documents d on l.doc_id = d.doc_id"""

EXCLUDED = """
select d.source as book_id, l.doc_id
from labels l join documents d on l.doc_id = d.doc_id where l.toxic = 1"""

# Sources as books: one row per book.
BOOKS = """
select source as book_id, concat('Volume ', source) as title, concat('Author of ', source) as author,
  case right(source, 1) when '0' then 'jpg' when '5' then 'jpg' when '1' then 'png' else null end
  as cover_ext
from (select distinct source from documents) s"""

# Pages as chapters: one book per host; page_id is the order in the book.
PAGES = r"""
select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as book_id,
  concat('page', cast(page_id as varchar(20))) as idref,
  concat(cast(page_id as varchar(20)), '.xhtml') as path,
  replace(replace(case page_id % 5
    when 0 then regexp_replace(html, '<title>[^<]*</title>', '<title>Cover</title>')
    when 1 then replace(html, '<article>', concat('<section title="Part ',
      cast(page_id % 4 as varchar(20)), ' &amp; more"><article>'))
    when 2 then replace(html, '<article>', '<section><article>')
    when 3 then replace(html, '<article>', '<article><script>count(1);</script>')
    else replace(html, '&copy;', '&#0000000000000000000000000169;&#x0000000000000000000000000041;') end,
  '</p>', '<sup class="c">12</sup></p><sup>*</sup>'),
  '. ', concat(' for $12 at 30 k.p.h. ', chr(160), chr(10), chr(10))) as html
from pages"""

# An entry for every page; one in seven names another file.
PAGE_TOC = """
select regexp_extract(p.url, '^[a-z]+://([^/]+)', 1) as book_id, p.page_id as pos,
  concat('OEBPS/', cast(p.page_id as varchar(20)), case p.page_id % 7 when 3 then '.pdf' else '.xhtml#a' end) as content,
  concat('Chapter ', cast(p.page_id as varchar(20)), ': q', coalesce(cast(l.quality as varchar(20)), '')) as label
from pages p left join labels l on l.doc_id = p.page_id"""

RULE_FILES = """
select p_partkey, concat('# rules of ', p_name, chr(10), p_name, '==', p_type, chr(13), chr(10),
  chr(10), '   # indented, no separator', chr(10), '  # indented==live rule', chr(10),
  p_brand, ' no separator', chr(10), 'a==b==', cast(p_size as varchar(20)), chr(10),
  'drop==', chr(10), '==x', case p_partkey % 2 when 0 then chr(10) else '' end) as value
from part"""

# Two rules per source; the second works on what the first wrote.
BOOK_RULES = """
select source as book_id, 1 as rule_pos, 'the|en' as pattern,
  concat('<', source, '>') as replacement from (select distinct source from documents) s
union all
select source as book_id, 2 as rule_pos, concat('<(', source, ')> ') as pattern,
  '$1 $$' as replacement from (select distinct source from documents) s"""

# Documents as whole archives: one book per document, one chapter per line.
ARCHIVES = r"""
select concat('book-', cast(doc_id as varchar(20)), '.epub') as path,
  concat('Book ', cast(doc_id as varchar(20)), ' & "more"') as title, source as author,
  case doc_id % 3 when 0 then 'image/jpeg' when 1 then 'image/gif' else null end as cover_mime,
  case doc_id % 9 when 1 then 'truncated' when 2 then 'no package' when 3 then 'no title'
    when 4 then 'no creator' when 5 then 'dangling spine' when 6 then 'not UTF-8'
    when 7 then 'missing section' else null end as defect,
  replace(text, chr(10), concat(' at 30 k.p.h. for $12', chr(10))) as text
from documents"""

# File names of archives, by number: patterns for some readers, hidden for others.
SPELLINGS = (
    "book-#.epub", "Title [v#].epub", "a{#,b}.epub", "_draft-#.epub", ".hid-#.epub", "what? 100%25 *#*.epub", "book-#.EPUB",
)
RULES = (("the", "THE"), ("THE end", "done"), ("ing", ""), (r"([a-z]+)en", "${1}EN"))
SKIPPED_TITLES = ": q0"

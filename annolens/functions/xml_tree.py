"""Article extraction from well-formed XML (O36, strict), by expressions only.

The markup is cut into tokens (tags, comments, CDATA, instructions, text) and
folded with a stack of the open elements.  Of every ``title``, ``p`` and ``sec``
below the root the text before its first child is kept, stripped, in document
order; an element in a namespace, by a prefix or by a default, is another one.

What a parser would refuse gives ``parse_error`` with the reason: tags that do
not match, a second root, text outside it, unbound prefixes, attributes given
twice, unknown entities, characters that XML does not have.  Entities that a
document type declares are unknown here, which is the one difference from a
parser that reads it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ARTICLE_TAGS

# Tokens and characters of XML: fixed values of the standard.
NAME = r"[A-Za-z_:\x{C0}-\x{10FFFF}][A-Za-z0-9_:.\x{B7}\x{C0}-\x{10FFFF}-]*"
ATTRIBUTE = rf"""\s+({NAME})\s*=\s*(?:"[^<"]*"|'[^<']*')"""
TAG = rf"""<{NAME}(?:\s+{NAME}\s*=\s*(?:"[^<"]*"|'[^<']*'))*\s*/?>"""
END_TAG = rf"</({NAME})\s*>"
TOKEN = rf"""<!--(?s:.*?)-->|<!\[CDATA\[(?s:.*?)\]\]>|<\?(?s:.*?)\?>|<!DOCTYPE(?:[^<>\[]|\[[^\]]*\])*>|{END_TAG}|{TAG}|<|[^<]+"""
DECLARATION = r"^<\?xml\s(?s:.*?)\?>"
ENTITY = r"&(?:lt|gt|amp|quot|apos|#[0-9]+|#x[0-9a-fA-F]+);"
NO_CHARACTER = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
WHITE = r"^\s+|\s+$"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _code_point(reference: str) -> str:
    """The number in ``&#10;`` or ``&#xA;``."""
    digits = f"regexp_extract({reference}, '([0-9a-fA-F]+);', 1)"
    return f"try_cast(conv({digits}, if(startswith({reference}, '&#x'), 16, 10), 10) as bigint)"


def _decoded(text: str) -> str:
    """Text with its references resolved (they have been found to be known ones)."""
    number = _code_point("x")
    named = " ".join(f"when x = '&{name};' then {value}" for name, value in (("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'"), ("quot", "'\"'"), ("apos", "'\\''")))
    return f"""if(contains({text}, '&'), array_join(transform(regexp_extract_all({text}, {_sql('&[^;]*;|[^&]+')}, 0), x ->
      case {named} when startswith(x, '&#') then decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32') else x end), ''), {text})"""


def _unknown(text: str) -> str:
    """Is there an & that begins no known reference, or a reference to no character?"""
    number = _code_point("x")
    allowed = f"({number} in (9, 10, 13) or {number} between 32 and 55295 or {number} between 57344 and 65533 or {number} between 65536 and 1114111)"
    return f"""(contains({text}, '&') and (contains(regexp_replace({text}, {_sql(ENTITY)}, ''), '&')
      or exists(regexp_extract_all({text}, {_sql('&#x?[0-9a-fA-F]+;')}, 0), x -> not coalesce({allowed}, false))))"""


_STATE = ("stack", "taking", "text", "kept", "rooted", "bad")


def _state(**changed: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {changed.get(k, f's.{k}')}" for k in _STATE) + ")"


# An open element is 'name|1 if in the default namespace|,declared prefixes,'.
_TOP = "coalesce(try_element_at(s.stack, -1), '|0|,xml,')"
_KEPT = f"if(s.taking and s.text <> '', array_append(s.kept, regexp_replace(s.text, {_sql(WHITE)}, '')), s.kept)"


def _start() -> str:
    """A start tag: t; the lambdas give names to what is read from it."""
    attributes = f"regexp_extract_all(t, {_sql(ATTRIBUTE)}, 0)"
    name = f"regexp_extract(t, {_sql('^<(' + NAME + ')')}, 1)"
    taken = ", ".join(f"'{x}'" for x in ARTICLE_TAGS)
    value = lambda x: f"regexp_extract({x}, {_sql(chr(61) + r'\s*.((?s:.*)).$')}, 1)"
    return f"""
      transform(array(named_struct('name', {name}, 'given', transform({attributes}, x -> regexp_extract(x, {_sql(NAME)}, 0)), 'all', {attributes})), e ->
      transform(array(named_struct('prefixes', concat(split_part({_TOP}, '|', 3), array_join(transform(filter(e.given, x -> startswith(x, 'xmlns:')), x -> concat(substring(x, 7), ',')), '')),
          'space', coalesce(get(transform(filter(e.all, x -> regexp_like(x, {_sql(r'^\s+xmlns\s*=')})), x -> if({value('x')} = '', '0', '1')), 0), split_part({_TOP}, '|', 2)))), n ->
        case when s.rooted and size(s.stack) = 0 then {_state(bad="'junk after the root'")}
          when size(array_distinct(e.given)) < size(e.given) then {_state(bad="'duplicate attribute'")}
          when exists(filter(array_append(e.given, e.name), x -> contains(x, ':') and not startswith(x, 'xmlns:')), x -> not contains(n.prefixes, concat(',', split_part(x, ':', 1), ',')))
            then {_state(bad="'unbound prefix'")}
          when exists(e.all, x -> {_unknown('x')}) then {_state(bad="'unknown entity'")}
          else {_state(stack="if(endswith(t, '/>'), s.stack, array_append(s.stack, concat(e.name, '|', n.space, '|', n.prefixes)))",
                       taking=f"size(s.stack) > 0 and not endswith(t, '/>') and n.space = '0' and e.name in ({taken})",
                       text="''", kept=_KEPT, rooted="true")} end)[0])[0]"""


def _fold(tokens: str) -> str:
    close = f"""case when size(s.stack) = 0 or split_part(try_element_at(s.stack, -1), '|', 1) <> regexp_extract(t, {_sql(END_TAG)}, 1)
        then {_state(bad="'mismatched tag'")}
      else {_state(stack="slice(s.stack, 1, size(s.stack) - 1)", taking="false", text="''", kept=_KEPT)} end"""
    said = "substring(t, 5, length(t) - 7)"
    comment = f"if(contains({said}, '--') or endswith({said}, '-'), {_state(bad=repr('-- in a comment'))}, s)"
    cdata = f"""if(size(s.stack) = 0, {_state(bad="'text outside the root'")}, {_state(text="if(s.taking, concat(s.text, substring(t, 10, length(t) - 12)), s.text)")})"""
    instruction = f"if(regexp_like(t, {_sql('^<.(?i:xml)[^A-Za-z0-9_.:-]')}), {_state(bad=repr('misplaced declaration'))}, s)"
    text = f"""case when size(s.stack) = 0 then if(regexp_replace(t, {_sql(WHITE)}, '') = '', s, {_state(bad="'text outside the root'")})
        when {_unknown('t')} then {_state(bad="'unknown entity'")}
        when contains(t, ']]>') then {_state(bad="'not well-formed'")}
        when s.taking then {_state(text=f"concat(s.text, {_decoded('t')})")} else s end"""
    return f"""aggregate({tokens}, named_struct('stack', cast(array() as array<string>), 'taking', false, 'text', '', 'kept', cast(array() as array<string>), 'rooted', false, 'bad', cast(null as string)),
      (s, t) -> case when s.bad is not null then s
        when startswith(t, '<!--') then {comment}
        when startswith(t, '<![CDATA[') then {cdata}
        when startswith(t, '<?') then {instruction}
        when startswith(t, '<!DOCTYPE') then if(s.rooted, {_state(bad="'misplaced document type'")}, s)
        when startswith(t, '</') then {close}
        when t = '<' then {_state(bad="'not well-formed'")}
        when startswith(t, '<') then {_start()}
        else {text} end,
      s -> named_struct('kept', s.kept, 'bad', case when s.bad is not null then s.bad when size(s.stack) > 0 then 'element not closed' when not s.rooted then 'no element' end))"""


def article_tree(name: str) -> Column:
    """Of the column of this name: struct(segments, status, error).

    ``ok``; ``parse_error`` with the reason and no segments; ``missing`` for NULL.
    """
    column = f"`{name}`"
    body = f"regexp_replace(regexp_replace(regexp_replace({column}, {_sql(chr(13) + '(?:' + chr(10) + ')?')}, '\\n'), {_sql(WHITE)}, ''), {_sql(DECLARATION)}, '')"
    tokens = f"regexp_extract_all({body}, {_sql(TOKEN)}, 0)"
    read = f"""if(regexp_like({column}, {_sql(NO_CHARACTER)}), named_struct('kept', cast(array() as array<string>), 'bad', 'no character of XML'), {_fold(tokens)})"""
    return F.expr(f"""if({column} is null, named_struct('segments', cast(null as array<string>), 'status', 'missing', 'error', cast(null as string)),
      transform(array({read}), r -> named_struct('segments', if(r.bad is null, r.kept, null), 'status', if(r.bad is null, 'ok', 'parse_error'), 'error', r.bad))[0])""")

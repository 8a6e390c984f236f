"""Pieces of SQL that several oracle queries share."""

SPACE = r"[\s\x{85}\x{a0}\x{b}\x{1c}-\x{1f}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'), '[^a-zA-Z0-9 .,;:!?()\\-]', ' ', 'g'), ' +', ' ', 'g'))"


def plain(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{sign}')"
    return f"trim(regexp_replace({out}, '[\\s\\x{{b}}]+', ' ', 'g'))"


def escaped(x: str) -> str:
    return f"replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


#: A page around each row of university_data, for the operators that take HTML.
HTML = (
    "concat('<html><head><title>', " + escaped("title") + ", '</title><style>p{}</style></head><body><nav>Menu</nav><script>var s=\"<p>x</p>\";</script><!-- note --><h1>', " + escaped("url") + ", '</h1><main><p>', replace(" + escaped("content")
    + ", chr(10), concat('</p>', chr(10), '<p>')), '</p></main><footer>Imprint</footer></body></html>')"
)


def distance(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"

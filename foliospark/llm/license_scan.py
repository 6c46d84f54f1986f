"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

A tag's expression runs to the end of its line. ``WITH`` binds before ``AND`` before ``OR``. Each licence has a rank from permissive to
proprietary: of alternatives the least counts, of joint terms the most, and a known exception eases a strong copyleft to a
weak one. All findings of a document hold jointly.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from foliospark.llm.arrow import id_and_text

RANKS = ("permissive", "weak copyleft", "copyleft", "restricted", "proprietary or unknown")
#: Ranks up to this one are allowed.
ALLOW = 1
_BY_RANK = (
    "0BSD AAL Abstyles Adobe-2006 Adobe-Glyph ADSL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 Afmparse AMDPLPA AML AMPAS ANTLR-PD Apache-1.0 Apache-1.1 Apache-2.0 APAFML Artistic-1.0-Perl Artistic-2.0 Bahyph Barr Beerware Bitstream-Vera blessing BlueOak-1.0.0 Borceux BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-Open-MPI BSD-4-Clause BSD-4-Clause-Shortened BSD-4-Clause-UC BSD-Source-Code BSL-1.0 bzip2-1.0.6 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-PDDC CC0-1.0 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CECILL-B CNRI-Jython CNRI-Python COIL-1.0 Community-Spec-1.0 Crossword CrystalStacker Cube curl diffmark DOC Dotseqn DRL-1.0 DSDP dvipdfm ECL-1.0 ECL-2.0 EFL-1.0 EFL-2.0 eGenix Entessa EUDatagrid Fair Freetype FSFAP FSFUL FSFULLR FTL Giftware Glulxe GLWTPL Graphics-Gems HaskellReport HPND HPND-sell-variant HTMLTIDY IBM-pibs ICU IJG ImageMagick Info-ZIP Intel ISC ISC-Veillard JasPer-2.0 Jam JSON Latex2e Leptonica Libpng libpng-2.0 libtiff Linux-OpenIB LPL-1.02 MakeIndex MirOS MIT MIT-0 MIT-advertising MIT-CMU MIT-enna MIT-feh MIT-Modern-Variant MIT-open-group MITNFA MS-LPL MTLL MulanPSL-1.0 MulanPSL-2.0 Multics Mup NAIST-2003 Naumen NBPL-1.0 NCSA Net-SNMP NetCDF Newsletr NIST-PD NIST-PD-fallback NIST-Software NLOD-1.0 NLOD-2.0 NLPL NRL NTP NTP-0 ODC-By-1.0 OFFIS OFL-1.0 OFL-1.1 OFL-1.1-RFN OFL-1.1-no-RFN OGL-UK-1.0 OGL-UK-2.0 OGL-UK-3.0 OLDAP-2.8 OML OpenSSL OPUBL-1.0 PDDL-1.0 PHP-3.0 PHP-3.01 Plexus PostgreSQL PSF-2.0 psfrag psutils Python-2.0 Python-2.0.1 Qhull Rdisc Ruby Saxpath SCEA SGI-B-2.0 SHL-0.5 SHL-0.51 SISSL-1.2 SMLNJ snprintf Spencer-86 Spencer-94 Spencer-99 SSH-OpenSSH SSH-short StandardML-NJ SWL TCL TCP-wrappers TMate TU-Berlin-1.0 TU-Berlin-2.0 UCAR Unicode-3.0 Unicode-DFS-2015 Unicode-DFS-2016 Unlicense UPL-1.0 Vim VSL-1.0 W3C W3C-19980720 W3C-20150513 Wsuipa WTFPL X11 X11-distribute-modifications-variant Xerox Xnet xpp XSkat Zed Zend-2.0 Zlib zlib-acknowledgement ZPL-1.1 ZPL-2.0 ZPL-2.1 LicenseRef-PublicDomain",
    "APL-1.0 APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 Artistic-1.0 BitTorrent-1.0 BitTorrent-1.1 CATOSL-1.1 CDDL-1.0 CDDL-1.1 CDLA-Sharing-1.0 CECILL-C CERN-OHL-W-2.0 CPAL-1.0 CPL-1.0 CUA-OPL-1.0 EPL-1.0 EPL-2.0 ErlPL-1.1 eCos-2.0 gSOAP-1.3b Interbase-1.0 IPA IPL-1.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LGPLLR LiLiQ-R-1.1 LPPL-1.0 LPPL-1.2 LPPL-1.3a LPPL-1.3c Motosoto MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL NASA-1.3 Nokia NPL-1.0 NPL-1.1 OCLC-2.0 OGTSL OSET-PL-2.1 RHeCos-1.1 RPSL-1.0 RSCPL SISSL SPL-1.0 SugarCRM-1.1.3 Sleepycat wxWindows YPL-1.1 ZIMBRA-1.3 Zimbra-1.4",
    "AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 CERN-OHL-S-2.0 copyleft-next-0.3.0 copyleft-next-0.3.1 CAL-1.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LiLiQ-Rplus-1.1 NGPL ODbL-1.0 OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1 OSL-3.0 Parity-6.0.0 Parity-7.0.0 QPL-1.0 RPL-1.1 RPL-1.5 SimPL-2.0 Watcom-1.0",
    "Aladdin BUSL-1.1 CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-4.0 Elastic-2.0 Hippocratic-2.1 NCGL-UK-2.0 PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0 Prosperity-3.0.0 SSPL-1.0",
    "LicenseRef-Proprietary NOASSERTION NONE",
)
RANK = {name: rank for rank, names in enumerate(_BY_RANK) for name in names.split()}
_CANON = {n.lower(): n for n in RANK}
for _n in list(_CANON):  # the older spelling: GPL-3.0 and GPL-3.0+
    if _n.endswith("-only"):
        _CANON[_n[:-5]] = _CANON[_n]
    elif _n.endswith("-or-later"):
        _CANON[_n[:-9] + "+"] = _CANON[_n]
EXCEPTIONS = {e.lower(): e for e in "389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-1.24 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 CLISP-exception-2.0 DigiRule-FOSS-exception eCos-exception-2.0 Fawkes-Runtime-exception FLTK-exception Font-exception-2.0 freertos-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 GPL-3.0-linking-exception i2p-gpl-java-exception LGPL-3.0-linking-exception Libtool-exception Linux-syscall-note LLVM-exception LZMA-exception mif-exception Nokia-Qt-exception-1.1 OCaml-LGPL-linking-exception OCCT-exception-1.0 OpenJDK-assembly-exception-1.0 openvpn-openssl-exception OpenSSL-exception PS-or-PDF-font-exception-20170817 Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Qwt-exception-1.0 Swift-exception u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1".split()}
TAGS = ("spdx-license-identifier:", "license-identifier:")
PHRASES = {
    "mit license": "MIT",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
    "apache license, version 2.0": "Apache-2.0",
    "apache license version 2.0": "Apache-2.0",
    "apache license 2.0": "Apache-2.0",
    "bsd 2-clause": "BSD-2-Clause",
    "2-clause bsd": "BSD-2-Clause",
    "simplified bsd license": "BSD-2-Clause",
    "bsd 3-clause": "BSD-3-Clause",
    "3-clause bsd": "BSD-3-Clause",
    "new bsd license": "BSD-3-Clause",
    "redistribution and use in source and binary forms, with or without modification": "BSD-2-Clause",
    "isc license": "ISC",
    "zlib license": "Zlib",
    "boost software license": "BSL-1.0",
    "mozilla public license 2.0": "MPL-2.0",
    "mozilla public license, version 2.0": "MPL-2.0",
    "mozilla public license, v. 2.0": "MPL-2.0",
    "eclipse public license 2.0": "EPL-2.0",
    "eclipse public license - v 2.0": "EPL-2.0",
    "gnu lesser general public license, version 3": "LGPL-3.0-only",
    "gnu lesser general public license version 3": "LGPL-3.0-only",
    "gnu lesser general public license, version 2.1": "LGPL-2.1-only",
    "gnu lesser general public license version 2.1": "LGPL-2.1-only",
    "gnu lesser general public license": "LGPL-2.0-or-later",
    "gnu affero general public license": "AGPL-3.0-only",
    "gnu general public license, version 2": "GPL-2.0-only",
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license, version 3": "GPL-3.0-only",
    "gnu general public license version 3": "GPL-3.0-only",
    "gnu general public license, version 2 or later": "GPL-2.0-or-later",
    "gnu general public license, version 3 or later": "GPL-3.0-or-later",
    "gnu general public license": "GPL-1.0-or-later",
    "cc0 1.0": "CC0-1.0",
    "cc by 4.0": "CC-BY-4.0",
    "cc by-sa 4.0": "CC-BY-SA-4.0",
    "cc by-nc 4.0": "CC-BY-NC-4.0",
    "cc by-nd 4.0": "CC-BY-ND-4.0",
    "cc by-nc-sa 4.0": "CC-BY-NC-SA-4.0",
    "cc by-nc-nd 4.0": "CC-BY-NC-ND-4.0",
    "creative commons attribution 4.0": "CC-BY-4.0",
    "creative commons attribution-sharealike 4.0": "CC-BY-SA-4.0",
    "creative commons attribution-noncommercial 4.0": "CC-BY-NC-4.0",
    "dedicated to the public domain": "LicenseRef-PublicDomain",
    "unlicense": "Unlicense",
    "server side public license": "SSPL-1.0",
    "business source license": "BUSL-1.1",
    "permission is hereby granted, free of charge, to any person or organization obtaining a copy": "BSL-1.0",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "ISC",
    "permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted": "ISC",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "gplv2": "GPL-2.0-only",
    "gplv3": "GPL-3.0-only",
    "gpl v2": "GPL-2.0-only",
    "gpl v3": "GPL-3.0-only",
    "lgplv3": "LGPL-3.0-only",
    "agplv3": "AGPL-3.0-only",
    "apache.org/licenses/license-2.0": "Apache-2.0",
    "opensource.org/licenses/mit": "MIT",
    "mozilla.org/mpl/2.0": "MPL-2.0",
    "creativecommons.org/licenses/by/4.0": "CC-BY-4.0",
    "creativecommons.org/licenses/by-sa/4.0": "CC-BY-SA-4.0",
    "creativecommons.org/licenses/by-nc/4.0": "CC-BY-NC-4.0",
    "creativecommons.org/licenses/by-nd/4.0": "CC-BY-ND-4.0",
    "creativecommons.org/licenses/by-nc-sa/4.0": "CC-BY-NC-SA-4.0",
    "creativecommons.org/licenses/by-nc-nd/4.0": "CC-BY-NC-ND-4.0",
    "all rights reserved": "LicenseRef-Proprietary",
    "proprietary and confidential": "LicenseRef-Proprietary",
}
#: Says something only where nothing else is found: most permissive notices have it in their first line.
WEAK = "all rights reserved"
#: Opens the notices of the BSD family, and the clauses by which its members differ.
BSD = "redistribution and use in source and binary forms, with or without modification"
CLAUSES = {"neither the name of": "BSD-3-Clause", "may not be used to endorse or promote products": "BSD-3-Clause", "all advertising materials mentioning features": "BSD-4-Clause"}
#: Follows a GNU licence's name: its version, and whether later ones will do.
_VERSION = re.compile(r"[^.]{0,110}?\b(?:version |v)(\d)(?:\.(\d))?(?: of the licen[cs]e)?,?(?P<later> ?(?:or|and) (?:\(?at your option\)? )?(?:any )?later)?")
_LATER = re.compile(r",? ?(?:\.0)?,? (?:or|and) (?:\(?at your option\)?,? )?(?:any )?later")
_TOKEN = re.compile(r"[()]|[^\s()]+")
_BINDS = {"or": 1, "and": 2, "with": 3}


def evaluate(expression: str) -> tuple[str, int]:
    """(normal form, rank) of a licence expression; NOASSERTION and the last rank if it isn't one."""
    bad = "NOASSERTION", RANK["NOASSERTION"]
    values: list[tuple[str, int, int]] = []  # text, rank, how tightly its top operator binds
    waiting: list[str] = []

    def reduce() -> bool:
        op = waiting.pop()
        if op == "(" or len(values) < 2:
            return False
        b, a = values.pop(), values.pop()
        binds = _BINDS[op]
        if op == "with":
            # Only a bare licence takes an exception, and only an exception can follow.
            if b[2] != 5 or a[2] != 4:
                return False
            values.append((f"{a[0]} WITH {b[0]}", min(a[1], 1) if a[1] == 2 and b[0].lower() in EXCEPTIONS else a[1], binds))
            return True
        if 5 in (a[2], b[2]):
            return False
        left, right = (f"({x[0]})" if x[2] < binds else x[0] for x in (a, b))
        values.append((f"{left} {op.upper()} {right}", max(a[1], b[1]) if op == "and" else min(a[1], b[1]), binds))
        return True

    operand = True  # an operand or "(" must come next
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in _BINDS:
            if operand:
                return bad
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                if not reduce():
                    return bad
            waiting.append(word)
            operand = True
        elif token == "(":
            if not operand:
                return bad
            waiting.append(token)
        elif token == ")":
            if operand:
                return bad
            while waiting and waiting[-1] != "(":
                if not reduce():
                    return bad
            if not waiting:
                return bad
            waiting.pop()
        else:
            if not operand:
                return bad
            if waiting and waiting[-1] == "with":
                values.append((EXCEPTIONS.get(word, word), 0, 5))
            else:
                name = _CANON.get(word, word)
                values.append((name, RANK.get(name, RANK["NOASSERTION"]), 4))
            operand = False
    if operand:
        return bad
    while waiting:
        if not reduce():
            return bad
    return (values[0][0], values[0][1]) if len(values) == 1 and values[0][2] != 5 else bad


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, name in (PHRASES | CLAUSES).items():
        a.add_word(phrase, (len(phrase), name))
    for tag in TAGS:
        a.add_word(tag, (len(tag), None))
    a.make_automaton()
    return a


_COMMENT_END = re.compile(r"\s*(?:\*/|-->|#\}|\"\"\"|\'\'\')?\s*$")
_LINE_END = re.compile("[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
#: A line break with the comment marks that the next line begins with.
_WRAP = re.compile("[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029][\\s]*(?:(?://+!?|/\\*+|\\*+/?|#+|;+|--+|%+|!+|>+|\\||dnl\\b|rem\\b|<!--)[ \t]*)*")
_SPACES = re.compile(r"\s{2,}|[^\S ]")


def _matches(flat: str) -> list[tuple[int, int, str | None]]:
    """(start, end, licence or None for a tag) of each match at word borders."""
    out = []
    for last, (n, name) in _automaton().iter(flat):
        first, end = last + 1 - n, last + 1
        if not (first and flat[first - 1].isalnum()) and not (name is not None and end < len(flat) and flat[end].isalnum()):
            out.append((first, end, name))
    return out


def _versioned(name: str, phrase: str, after: str) -> str:
    """A GNU licence with the version that the text goes on to name, if the phrase has none, and "or later" if it says so."""
    family = name.split("-", 1)[0]
    if phrase.endswith("license"):
        if found := _VERSION.match(after):
            exact = f"{family}-{found[1]}.{found[2] or 0}-{'or-later' if found['later'] else 'only'}"
            return exact if exact in RANK else name
    elif name.endswith("-only") and _LATER.match(after):
        return f"{name[:-5]}-or-later"
    return name


def findings(text: str) -> tuple[list[str], list[str]]:
    """(tag expressions, licences of notices), in order. Case, line breaks and the comment marks after them don't matter; of overlapping matches the longest counts.

    A reserved right is a notice of its own only where there is no other and no tag.
    """
    lower = text.lower()
    tags: list[str] = []
    notices: list[str] = []
    hits = _matches(lower)
    # Line breaks and comment marks must go for the phrases to match, but then the lines that end a tag's expression can't be found.
    flat = _SPACES.sub(" ", _WRAP.sub(" ", lower))
    notes = _matches(flat) if flat != lower else hits
    end = -1
    for a, b, _ in sorted((h for h in hits if h[2] is None), key=lambda h: (h[0], -h[1])):
        if a >= end:
            stop = _LINE_END.search(lower, b)
            tags.append(_COMMENT_END.sub("", lower[b : stop.start() if stop else len(lower)]).strip())
            end = b
    end, weak, open_bsd = -1, 0, None
    for a, b, name in sorted((h for h in notes if h[2] is not None), key=lambda h: (h[0], -h[1])):
        phrase = flat[a:b]
        if a < end:
            continue
        if phrase in CLAUSES:
            # The clauses come after the opening; that of four has the others', too.
            if open_bsd is not None and notices[open_bsd] < name:
                notices[open_bsd] = name
            continue
        end = b
        if phrase == WEAK:
            weak += 1
            continue
        if phrase == BSD:
            open_bsd = len(notices)
        notices.append(_versioned(name, phrase, flat[b : b + 200]) if "GPL" in name else name)
    return tags, notices if notices or tags else [PHRASES[WEAK]] * weak


def judge(text: str | None, allow: int = ALLOW) -> tuple[int, int, list[str], str | None, str, bool]:
    """(tags, notices, terms, expression, category, allowed) of a document."""
    tags, notices = findings(text) if text else ([], [])
    parts: dict[str, int] = {}
    for t in tags:
        name, rank = evaluate(t)
        parts[name] = rank
    for n in notices:
        parts[n] = RANK[n]
    if not parts:
        return 0, 0, [], None, "none", True
    terms = sorted(parts)
    rank = max(parts.values())
    expression = " AND ".join(f"({t})" if " " in t and len(terms) > 1 else t for t in terms)
    return len(tags), len(notices), terms, expression, RANKS[rank], rank <= allow


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: int = ALLOW) -> DataFrame:
    """(doc_id, n_tags, n_notices, licenses, expression, category, allowed) for each row of docs.

    licenses has each distinct term once, sorted. Documents without a finding, with null and empty texts among them, have
    category ``none``, a null expression, and are allowed. An identifier that isn't among the known ones is unknown, so not allowed. A tag that isn't followed by an expression counts as NOASSERTION.
    Rows that repeat are scanned each, rows without a doc_id too. An empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            rows = [judge(t, allow) for t in batch.column(1).to_pylist()]
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], ["doc_id", "n_tags", "n_notices", "licenses", "expression", "category", "allowed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tags int, n_notices int, licenses array<string>, expression string, category string, allowed boolean")

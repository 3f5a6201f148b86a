"""Licence patterns and metadata."""

from __future__ import annotations

from typing import NamedTuple


class License(NamedTuple):
    spdx_id: str
    name: str
    category: str
    patterns: tuple[str, ...]
    requires_attribution: bool
    commercial_allowed: bool
    modification_allowed: bool
    distribution_allowed: bool
    compatible: bool


# Patterns, order and flags must equal the published table, since
# pattern length sets the confidence and table order breaks ties.

LICENSES = (
    License("MIT", "MIT License", "permissive", (
        r"MIT\s+License",
        r"Permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge",
        r"The\s+MIT\s+License\s+\(MIT\)",
        r"SPDX-License-Identifier:\s*MIT",
    ), True, True, True, True, True),
    License("Apache-2.0", "Apache License 2.0", "permissive", (
        r"Apache\s+License,?\s+Version\s+2\.0",
        r"Licensed\s+under\s+the\s+Apache\s+License",
        r"SPDX-License-Identifier:\s*Apache-2\.0",
    ), True, True, True, True, True),
    License("BSD-2-Clause", "BSD 2-Clause License", "permissive", (
        r"BSD\s+2-Clause",
        r"Redistributions\s+of\s+source\s+code\s+must\s+retain",
        r"Simplified\s+BSD\s+License",
    ), True, True, True, True, True),
    License("BSD-3-Clause", "BSD 3-Clause License", "permissive", (
        r"BSD\s+3-Clause",
        r"Neither\s+the\s+name\s+of.*nor\s+the\s+names\s+of\s+its\s+contributors",
    ), True, True, True, True, True),
    License("ISC", "ISC License", "permissive", (
        r"ISC\s+License",
        r"Permission\s+to\s+use,?\s+copy,?\s+modify,?\s+and/or\s+distribute",
        r"SPDX-License-Identifier:\s*ISC",
    ), True, True, True, True, True),
    License("Unlicense", "The Unlicense", "permissive", (
        r"This\s+is\s+free\s+and\s+unencumbered\s+software",
        r"THE\s+UNLICENSE",
        r"released\s+into\s+the\s+public\s+domain",
    ), False, True, True, True, True),
    License("CC0-1.0", "Creative Commons Zero v1.0 Universal", "permissive", (
        r"CC0\s+1\.0",
        r"Creative\s+Commons\s+Zero",
        r"No\s+Copyright",
    ), False, True, True, True, True),
    License("WTFPL", "Do What The F*ck You Want To Public License", "permissive", (
        r"WTFPL",
        r"DO\s+WHAT\s+THE\s+FUCK\s+YOU\s+WANT\s+TO",
        r"Sam\s+Hocevar",
    ), False, True, True, True, True),
    License("LGPL-2.1", "GNU Lesser General Public License v2.1", "weak_copyleft", (
        r"GNU\s+Lesser\s+General\s+Public\s+License.*2\.1",
        r"LGPL-2\.1",
    ), True, True, True, True, True),
    License("LGPL-3.0", "GNU Lesser General Public License v3.0", "weak_copyleft", (
        r"GNU\s+Lesser\s+General\s+Public\s+License.*3\.0",
        r"LGPL-3\.0",
    ), True, True, True, True, True),
    License("MPL-2.0", "Mozilla Public License 2.0", "weak_copyleft", (
        r"Mozilla\s+Public\s+License.*2\.0",
        r"MPL-2\.0",
    ), True, True, True, True, True),
    License("GPL-2.0", "GNU General Public License v2.0", "strong_copyleft", (
        r"GNU\s+General\s+Public\s+License.*(?:version\s+)?2",
        r"GPL-2\.0",
        r"GPLv2",
    ), True, True, True, True, False),
    License("GPL-3.0", "GNU General Public License v3.0", "strong_copyleft", (
        r"GNU\s+General\s+Public\s+License.*(?:version\s+)?3",
        r"GPL-3\.0",
        r"GPLv3",
    ), True, True, True, True, False),
    License("AGPL-3.0", "GNU Affero General Public License v3.0", "strong_copyleft", (
        r"GNU\s+Affero\s+General\s+Public\s+License",
        r"AGPL-3\.0",
    ), True, True, True, True, False),
    License("BUSL-1.1", "Business Source License 1.1", "restricted", (
        r"Business\s+Source\s+License",
        r"BUSL-1\.1",
    ), True, False, True, True, False),
    License("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "restricted", (
        r"CC-BY-NC",
        r"Creative\s+Commons.*NonCommercial",
        r"Attribution-NonCommercial",
    ), True, False, True, True, False),
    License("PROPRIETARY", "Proprietary License", "proprietary", (
        r"All\s+rights\s+reserved",
        r"Proprietary",
        r"Copyright.*All\s+rights\s+reserved",
    ), True, False, False, False, False),
)
SPDX_TAG = r"SPDX-License-Identifier:\s*(\S+)"
MAX_PATTERN_CONFIDENCE = 0.9
BASE_CONFIDENCE = 0.5
LENGTH_UNIT = 200

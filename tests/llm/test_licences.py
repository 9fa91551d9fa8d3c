"""Labels of licence notices in fifty sentences."""

from test_llm import table

from lettertrail.llm import license_scan

KNOWN = [
    ("GNU General Public License v3", "gpl,gpl-3.0"), ("GNU General Public License, version 2 or later", "gpl,gpl-2.0"), ("Lesser General Public License v2.1", "gpl"),
    ("GNU Lesser General Public License v2.1", "gpl,lgpl-2.1"), ("GNU Lesser General Public License version 3.0", "gpl,lgpl-3.0"), ("the GNU Affero General Public License, version 3", "agpl-3.0,gpl"),
    ("Apache License v2.0", "apache,apache-2.0"), ("Apache License, Version 2.0", "apache,apache-2.0"), ("Licensed under the Apache License", "apache"), ("Apache-2.0 license", "apache-2.0"),
    ("Apache Software License 1.1", "apache-1.1"), ("Mozilla Public License 2.0", "mpl-2.0"), ("Mozilla Public License, v. 2.0", "mpl"), ("Mozilla Public License version 1.1", "mpl-1.1"),
    ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"), ("SPDX-License-Identifier: BSL-1.0", "boost"), ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3.0"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl-2.1"),
    ("SPDX-License-Identifier: AGPL-3.0", "agpl-3.0"), ("SPDX-License-Identifier: Apache-2.0 OR MIT", "apache-2.0,mit"), ("SPDX-License-Identifier: (GPL-2.0-or-later AND BSD-3-Clause)", "bsd-3-clause,gpl-2.0"),
    ("SPDX-License-Identifier: MIT AND CC-BY-SA-4.0 AND ISC", "cc-by-sa,isc,mit"), ("SPDX-License-Identifier: MIT\nimport vim", "mit"), ("SPDX-License-Identifier: 0BSD", "bsd-0-clause"),
    ("SPDX-License-Identifier: CC0-1.0", "cc0"), ("SPDX-License-Identifier: Zlib", "zlib"), ("SPDX-License-Identifier: EPL-2.0", "epl-2.0"), ("MIT License", "mit"), ("mitigation license", ""), ("The MIT licence", "mit"),
    ("released under the BSD 3-Clause License", "bsd-3-clause"), ("2-clause BSD license", "bsd-2-clause"), ("the Expat license", "mit"), ("distributed under the ISC license", "isc"),
    ("Eclipse Public License v1.0", "epl-1.0"), ("Eclipse Public License - v 2.0", "epl"), ("Boost Software License", "boost"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("available under Creative Commons Attribution-ShareAlike license", "cc-by-sa"), ("released into the public domain", "public-domain"), ("All rights reserved.", "all-rights-reserved"),
    ("Copyright (c) 2020 Ann", "copyright"), ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"), ("provided without warranty of any kind", "warranty-disclaimer"),
    ("Proprietary and confidential", "proprietary"), ("subject to the terms of the GPL", "gpl"), ("general public license", "gpl"), ("a license to park", ""), ("the artistic license 2.0", "artistic-2.0"),
    ("under the apache helicopter", ""), ("nothing at all", ""),
]


def test_known_labels(spark):
    out = {r["doc_id"]: r["labels"] for r in license_scan.scan(table(spark, list(enumerate(text for text, _ in KNOWN)))).collect()}
    assert [(text, out[i]) for i, (text, _) in enumerate(KNOWN)] == KNOWN

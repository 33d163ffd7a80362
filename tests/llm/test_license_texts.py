"""Licence files that hold a license's text without a line that names it."""

from quakeloom.llm import license_scans

MIT = """Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
ISC = """Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
TWO = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THREE = TWO + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_full_texts_license_their_directory(spark):
    rows = []
    for n, text in enumerate([MIT, ISC, TWO, THREE, "Permission is hereby granted to walk on the lawn, free of charge."]):
        rows += [(10 * n, f"d{n}/COPYING", text), (10 * n + 1, f"d{n}/a/b.txt", "no word of it")]
    rows += [(90, "e/notes.txt", MIT), (91, "f/LICENSE", None)]
    got = {r.doc_id: (r.license, r.how) for r in license_scans.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    expected = {90: (None, None), 91: (None, None), 40: (None, None), 41: (None, None)}
    for n, name in enumerate(["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"]):
        expected |= {10 * n: (name, "text"), 10 * n + 1: (name, "inherited")}
    assert got == expected


def test_lines_of_real_files(spark):
    lines = {
        "// SPDX-License-Identifier: MIT": "MIT",
        "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "/* SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0",
        "SPDX-License-Identifier: LGPL-3.0-or-later": "LGPL-3.0",
        "SPDX-License-Identifier: LicenseRef-Own": None,
        "The MIT License (MIT)": "MIT",
        "MIT License": "MIT",
        "BSD 2-Clause License": "BSD-2-Clause",
        "BSD 3-Clause License": "BSD-3-Clause",
        "ISC License": "ISC",
        'Licensed under the Apache License, Version 2.0 (the "License");': "Apache-2.0",
        "Licensed under the Apache Software License, Version 1.1": "Apache-1.1",
        "Licensed under GPL version 2 only": "GPL-2.0",
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU General Public License.": None,
        "GNU GENERAL PUBLIC LICENSE": None,
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
        "my driving licence": None,
    }
    rows = [(n, f"d{n}/x.c", line) for n, line in enumerate(lines)]
    got = {r.doc_id: r.license for r in license_scans.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {line: got[n] for n, line in enumerate(lines)} == lines

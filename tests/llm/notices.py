"""Notices as they stand in files, and prose that resembles them. None is a template word for word, or all of them are wrapped."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Stone Works nor the names of its contributors may be
   used to endorse or promote products derived from this software without
   specific prior written permission."""

APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""


def gnu(name: str, what: str) -> str:
    return f"""This {what} is free software: you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This {what} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU {name} for more details.

You should have received a copy of the GNU {name}
along with this {what}.  If not, see <https://www.gnu.org/licenses/>."""


MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means."""

FAMILIES = {
    "mit": [MIT, "This package is released under the MIT license.", "License: MIT License"],
    "bsd": [BSD, "The code is licensed under the BSD 2-Clause License."],
    "apache": [APACHE, "Licensed under the Apache License, Version 2.0."],
    "gpl": [gnu("General Public License", "program"), "Released under the GNU General Public License, version 3 or later"],
    "lgpl": [gnu("Lesser General Public License", "library"), "This library is licensed under the GNU Lesser General Public License, version 3"],
    "agpl": [gnu("Affero General Public License", "program")],
    "mpl": [MPL],
    "isc": [ISC],
    "unlicense": [UNLICENSE],
    "cc-by": ["Except where noted, this work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}

FOREIGN = [
    """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.""",
    "Distributed under the zlib license, see the file COPYING",
    "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "Licensed under the EUPL, Version 1.2. You may not use this work except in compliance with the Licence.",
    "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt",
    "Licensed under the Artistic License 1.0",
    "Copyright 2019 Stone Works. All rights reserved. No part may be reproduced without permission.",
    "Licensed under the Open Software License version 3.0",
    "All rights reserved.",
]

PROSE = [
    "The committee published its report on the general state of the public library in spring.",
    "She asked for permission to copy the file, and the team granted it free of charge.",
    "The copyright of the photograph belongs to the newspaper that published it.",
    "Version 2 of the program was distributed with the magazine and sold many copies.",
    "He renewed his fishing license at the office and bought a map of the foundation stones.",
    "You may obtain a copy of the form at the desk; the conditions are printed on its back.",
    "Apache spread over the north before the Mozilla team arrived in January.",
    "The author waived the fee and spoke about the work of the commons.",
    "Subject to the following weather, the match will be played without restriction of numbers.",
    "The contributors to the volume were named after the holder of the chair.",
]

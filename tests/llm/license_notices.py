"""Notices as works carry them, with their family; none is a template. NAMED were at hand while the templates were written,
HELD_OUT were written afterwards and not used for any choice."""

NAMED = [
    ("unlicense", "This is free and unencumbered software released into the public domain."), ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"), ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"),
    ("wtfpl", "This program is under the WTFPL license, see copying"), ("cc-by-nd", "Licensed under CC BY-ND 4.0"), ("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1."), ("eupl", "Licensed under the EUPL, Version 1.2 or later"),
    ("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3"), ("mit", "MIT License"), ("mit", "See the LICENSE file (MIT)"), ("cc-by", "https://creativecommons.org/licenses/by/4.0/"),
    ("gpl", "SPDX-License-Identifier: GPL-2.0"), ("cc-by-nc-sa", "licensed under CC BY-NC-SA 4.0"), ("apache", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n'),
    ("gpl", "This file is part of Foo. Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"), ("lgpl", "SPDX-License-Identifier: LGPL-2.1-or-later"), ("agpl", "This project uses the AGPL-3.0 license"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"), ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."), ("artistic", "You may distribute this module under the terms of the Artistic License 2.0"),
    ("isc", "ISC License"), ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0"), ("cc-by-sa", "Content is available under Creative Commons Attribution-ShareAlike License unless otherwise noted."),
    ("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License (the License)."), ("odbl", "Data available under the Open Database License"), ("ms-pl", "Released under the Microsoft Public License (Ms-PL)"), ("psf", "Licensed under the Python Software Foundation License"),
    ("postgresql", "PostgreSQL is released under the PostgreSQL License"), ("public-domain", "This work has been released into the public domain by its author"), ("upl", "Licensed under the Universal Permissive License v 1.0"), ("proprietary", "© 2021 Example Corp. All rights reserved."),
    ("php", "This source file is subject to version 3.01 of the PHP license"), ("cc-by-nc", "You may share this under a Creative Commons Attribution-NonCommercial 4.0 International License"), ("cc-by-nc-nd", "CC BY-NC-ND 4.0 licensed"),
]

HELD_OUT = [
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program."), ("agpl", "// SPDX-License-Identifier: AGPL-3.0-or-later"), ("apache", "The library is open source and licensed under Apache 2.0."), ("apache", "This project is licensed under the terms of the Apache License 2.0 - see the LICENSE file for details"),
    ("artistic", "This is free software; you may use it under the Artistic License 2.0."), ("boost", "SPDX-License-Identifier: BSL-1.0"), ("boost", "Use, modification and distribution are subject to the Boost Software License, Version 1.0."), ("bsd", "This package is distributed under the BSD 2-Clause license."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"), ("bsd", "Code is provided under a BSD license."), ("cc0", "License: CC0"), ("cc0", "The data set is released under CC0 1.0 Universal"),
    ("cc-by", "Except where otherwise noted, this article is licensed under a Creative Commons Attribution 4.0 International License."), ("cc-by", "Figures are shared under CC BY 4.0"), ("cc-by-nc", "This chapter is licensed under CC BY-NC 4.0."), ("cc-by-nc", "See http://creativecommons.org/licenses/by-nc/4.0/ for the terms"),
    ("cc-by-nc-nd", "This is an open access article under the CC BY-NC-ND license"), ("cc-by-nc-nd", "http://creativecommons.org/licenses/by-nc-nd/4.0/"), ("cc-by-nc-sa", "These slides are distributed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), ("cc-by-nd", "This report is published under the Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."), ("cc-by-sa", "All photographs: CC BY-SA 4.0"), ("cddl", "You may not use this file except in compliance with the Common Development and Distribution License."), ("epl", "SPDX-License-Identifier: EPL-2.0"),
    ("epl", "Eclipse Public License - v 2.0"), ("eupl", "This software is provided under the European Union Public Licence v1.2"), ("gfdl", "The manual is covered by the GNU Free Documentation License."), ("gpl", "This program is free software; you can redistribute it under the GNU General Public License, version 2 or any later version."),
    ("gpl", "License: GPLv3"), ("gpl", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"), ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears"), ("isc", "This module is available under the ISC license."),
    ("lgpl", "This library is free software; it may be used under the GNU Lesser General Public License, version 2.1."), ("lgpl", "Qt is licensed under the LGPL."), ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."), ("mit", "Distributed under the MIT license, see COPYING."),
    ("mit", "SPDX-License-Identifier: MIT"), ("mpl", "Firefox is covered by the Mozilla Public License 2.0"), ("mpl", "SPDX-License-Identifier: MPL-2.0"), ("ms-pl", "The sample is subject to the Microsoft Public License."), ("odbl", "OpenStreetMap data is licensed under the Open Data Commons Open Database License"), ("ofl", "The typeface is free and released under the SIL Open Font License."),
    ("php", "The extension is covered by the PHP License, version 3.01"), ("postgresql", "The driver is distributed under the PostgreSQL License"), ("proprietary", "Copyright 1998-2004 Some Company. All rights reserved."), ("proprietary", "No part of this publication may be reproduced in any form without permission of the copyright holder."), ("proprietary", "© Verlag GmbH, alle Rechte vorbehalten"),
    ("psf", "It is made available under the Python Software Foundation License"), ("public-domain", "The author has placed this work in the public domain."), ("unlicense", "SPDX-License-Identifier: Unlicense"), ("unlicense", "For more information on the Unlicense, see the file UNLICENSE"), ("upl", "SPDX-License-Identifier: UPL-1.0"),
    ("wtfpl", "It is licensed under the WTFPL"), ("zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."), ("zlib", "The code is under the zlib license"),
]

CLEAN = [
    "She studied at MIT and lost her driving license there", "The eclipse was visible to the public; no license was needed", "All rights of way are reserved for farmers", "He renewed his driving license and all rights reserved for the seats of the upper row were sold out", "The MIT campus is open under the new rules",
    "A fishing licence is available under the bridge", "The commons are public land", "Permission to land was refused", "The Apache nation lives in the southwest", "The board reserved its rights", "He holds a pilot licence and a boat licence", "Copyright law was the subject of her thesis", "The licence fee rises in April",
    "Public domain names are sold by registrars", "The general public needs no permission", "The boost was released under pressure", "The warranty covers the engine", "Their creative commons project ended", "The artistic director got a license to film", "The software is licensed per seat", "The licensing authority of the city moved",
    "A mozilla developer spoke about rights", "Wine is sold under licence", "License plates were covered by snow", "The distribution of seats is subject to change", "She was granted a licence to teach", "Under the terms of the contract the shop may close", "The isc meeting is in the hall", "The zlib of the ship was a small boat", "Redistribution of land was permitted",
    "The rights to the song were reserved by the band", "The gnu grazes at dusk", "He has no licence for the gun", "The museum is open to the public without permission", "The union published its terms", "The licence was revoked by the council", "The cc line of the mail was empty", "The law permitted the sale", "The reserved table was free", "Their domain is history",
    "The python slept; its licence was on the wall", "The expat community met at the license office", "A universal remote needs no license", "She reserved all rooms", "The free documentation was handed out", "His license was under review", "No warranty was given on the car", "The eu public sector has rights", "The open font of the church is old", "A database of licences is kept by the county",
]

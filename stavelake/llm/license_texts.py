"""Templates of license scans: how common public licenses are named, and their grants and standard notices.

Fixed values, as the licenses word them, in small letters and without signs. Words in capitals, and numbers, tell one
license from another and must not be missing.
"""

GPL = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
LGPL = "this library is free software you can redistribute it and or modify it under the terms of the gnu LESSER general public license as published by the free software foundation"

TEMPLATES = [
    # names in running text
    ("apache-2.0", "licensed under the APACHE license version 2 0"),
    ("mit", "released under the MIT license"),
    ("mit", "licensed under the MIT license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl-2.1", "licensed under the gnu LESSER general public license version 2 1"),
    ("lgpl-3.0", "licensed under the gnu LESSER general public license version 3"),
    ("agpl-3.0", "licensed under the gnu AFFERO general public license version 3"),
    ("cc-by-nc-4.0", "licensed under CC BY NC 4 0"),
    ("cc-by-sa-4.0", "licensed under CC BY SA 4 0"),
    ("cc-by-4.0", "licensed under CC BY 4 0"),
    ("cc-by-4.0", "licensed under a creative commons ATTRIBUTION 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution SHAREALIKE 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution NONCOMMERCIAL 4 0 international license"),
    ("mpl-2.0", "licensed under the MOZILLA public license version 2 0"),
    ("bsd", "licensed under the BSD 3 clause license"),
    ("ofl-1.1", "this font software is licensed under the SIL open font license version 1 1"),
    ("gpl-2.0", "licensed under GPL 2 0"),
    ("gpl-3.0", "licensed under GPL 3 0"),
    ("gpl-2.0", "licensed under the GPLV2"),
    ("gpl-3.0", "licensed under the GPLV3"),
    ("lgpl-2.1", "licensed under LGPL 2 1"),
    ("agpl-3.0", "licensed under AGPL 3 0"),
    # headings of license files
    ("mit", "MIT license copyright c"),
    ("isc", "ISC license copyright c"),
    ("apache-2.0", "APACHE license version 2 0 january 2004"),
    # one line in source files
    ("mit", "spdx license identifier MIT"),
    ("isc", "spdx license identifier ISC"),
    ("apache-2.0", "spdx license identifier APACHE 2 0"),
    ("gpl-2.0", "spdx license identifier GPL 2 0"),
    ("gpl-3.0", "spdx license identifier GPL 3 0"),
    ("lgpl-2.1", "spdx license identifier LGPL 2 1"),
    ("agpl-3.0", "spdx license identifier AGPL 3 0"),
    ("mpl-2.0", "spdx license identifier MPL 2 0"),
    ("bsd", "spdx license identifier BSD 3 clause"),
    ("bsd", "spdx license identifier BSD 2 clause"),
    # grants and notices
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or ORGANIZATION obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "licensed under the APACHE license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl-3.0", f"{GPL} either version 3 of the license or at your option any later version"),
    ("gpl-2.0", f"{GPL} either version 2 of the license or at your option any later version"),
    ("lgpl-2.1", f"{LGPL} either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0", f"{LGPL} either version 3 of the license or at your option any later version"),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu AFFERO general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("mpl-2.0", "this source code form is subject to the terms of the MOZILLA public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the ECLIPSE public license 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
]

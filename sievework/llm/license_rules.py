"""Signatures of licences over a text's words.

One rule a line: tier, label, keyword, pattern.  A pattern is a regular expression
over lower-case words parted by single blanks, as punctuation is; it begins and
ends with whole words.  A text is searched for a pattern only if it holds the
keyword, in which _ stands for a blank.  Tiers, the best first: 1 machine-readable tags, 2 wording of a licence's
own text, 3 a stated grant, 4 a full name, 5 a short name or an address.  Specific
patterns take in what surrounds them, so that general ones lie inside them.
"""

from __future__ import annotations

CONFIDENCE = {1: 1.0, 2: 0.95, 3: 0.9, 4: 0.75, 5: 0.5}

_TEXT = r"""
1 mit spdx :: spdx license identifier mit
1 mit-0 spdx :: spdx license identifier mit 0
1 apache-2 spdx :: spdx license identifier apache 2( 0)?
1 apache-1.1 spdx :: spdx license identifier apache 1 1
1 apache-2-llvm spdx :: spdx license identifier apache 2 0 with llvm exception
1 bsd-2-clause spdx :: spdx license identifier bsd 2 clause
1 bsd-3-clause spdx :: spdx license identifier bsd 3 clause
1 bsd-4-clause spdx :: spdx license identifier bsd 4 clause
1 bsd-0-clause spdx :: spdx license identifier 0bsd
1 isc spdx :: spdx license identifier isc
1 zlib spdx :: spdx license identifier zlib
1 gpl-1 spdx :: spdx license identifier gpl 1 0( only| or later)?
1 gpl-2 spdx :: spdx license identifier gpl 2 0( only| or later)?
1 gpl-3 spdx :: spdx license identifier gpl 3 0( only| or later)?
1 gpl-2-classpath spdx :: spdx license identifier gpl 2 0( only| or later)? with classpath exception 2 0
1 lgpl-2.0 spdx :: spdx license identifier lgpl 2 0( only| or later)?
1 lgpl-2.1 spdx :: spdx license identifier lgpl 2 1( only| or later)?
1 lgpl-3 spdx :: spdx license identifier lgpl 3 0( only| or later)?
1 agpl-3 spdx :: spdx license identifier agpl 3 0( only| or later)?
1 mpl-1.1 spdx :: spdx license identifier mpl 1 1
1 mpl-2 spdx :: spdx license identifier mpl 2 0
1 epl-1 spdx :: spdx license identifier epl 1 0
1 epl-2 spdx :: spdx license identifier epl 2 0
1 eupl-1.2 spdx :: spdx license identifier eupl 1 2
1 cddl-1.0 spdx :: spdx license identifier cddl 1 0
1 cddl-1.1 spdx :: spdx license identifier cddl 1 1
1 bsl-1.0 spdx :: spdx license identifier bsl 1 0
1 busl-1.1 spdx :: spdx license identifier busl 1 1
1 sspl-1.0 spdx :: spdx license identifier sspl 1 0
1 unlicense spdx :: spdx license identifier unlicense
1 wtfpl spdx :: spdx license identifier wtfpl
1 cc0-1.0 spdx :: spdx license identifier cc0 1 0
1 cc-by spdx :: spdx license identifier cc by [1-4] [05]
1 cc-by-sa spdx :: spdx license identifier cc by sa [1-4] [05]
1 cc-by-nc spdx :: spdx license identifier cc by nc [1-4] [05]
1 cc-by-nd spdx :: spdx license identifier cc by nd [1-4] [05]
1 cc-by-nc-sa spdx :: spdx license identifier cc by nc sa [1-4] [05]
1 cc-by-nc-nd spdx :: spdx license identifier cc by nc nd [1-4] [05]
1 ofl-1.1 spdx :: spdx license identifier ofl 1 1
1 artistic-1.0 spdx :: spdx license identifier artistic 1 0( perl| cl8)?
1 artistic-2 spdx :: spdx license identifier artistic 2 0
1 postgresql spdx :: spdx license identifier postgresql
1 python-2 spdx :: spdx license identifier (python|psf) 2 0
1 ncsa spdx :: spdx license identifier ncsa
1 odbl-1.0 spdx :: spdx license identifier odbl 1 0
1 blueoak-1.0 spdx :: spdx license identifier blueoak 1 0 0
1 mulan-psl-2 spdx :: spdx license identifier mulanpsl 2 0
1 gfdl spdx :: spdx license identifier gfdl 1 [1-3]( only| or later| invariants| no invariants)*
1 ms-pl spdx :: spdx license identifier ms pl
1 ms-rl spdx :: spdx license identifier ms rl
1 upl-1.0 spdx :: spdx license identifier upl 1 0
1 ecl-2.0 spdx :: spdx license identifier ecl 2 0
1 osl-3.0 spdx :: spdx license identifier osl 3 0
1 afl-3.0 spdx :: spdx license identifier afl 3 0
1 vim spdx :: spdx license identifier vim
1 x11 spdx :: spdx license identifier x11
1 curl spdx :: spdx license identifier curl
1 openssl spdx :: spdx license identifier openssl
1 ruby spdx :: spdx license identifier ruby
1 json spdx :: spdx license identifier json
2 mit permission :: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)?
2 mit permission :: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
2 mit warranty :: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
2 isc permission :: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 isc permission :: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
2 bsd-0-clause permission :: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties
2 bsd redistribution :: redistribution and use in source and binary forms with or without modification are permitted( provided that the following conditions are met)?
2 bsd redistribution :: redistributions of source code must retain the above copyright notice
2 bsd redistribution :: redistributions in binary form must reproduce the above copyright notice
2 bsd-3-clause neither_the_name :: neither the name of [^ ]+( [^ ]+){0,12} nor the names of (its|their|the) contributors may be used to endorse or promote products derived from this software
2 bsd-4-clause advertising_materials :: all advertising materials mentioning features or use of this software must display the following acknowledgement
2 apache-2 compliance_with :: you may not use this file except in compliance with the license( you may obtain a copy of the license at)?
2 apache-2 applicable_law :: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
2 apache-2 apache_software :: licensed to the apache software foundation asf under one or more contributor license agreements
2 apache-2 royalty_free :: subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
2 apache-1.1 apache :: this product includes software developed by the apache software foundation
2 gpl free_software :: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license( as published by the free software foundation)?
2 gpl-2 free_software :: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2( of the license)?( or at your option any later version)?
2 gpl-3 free_software :: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3( of the license)?( or at your option any later version)?
2 gpl gnu :: you should have received a copy of the gnu general public license along with this (program|software|library|file)
2 gpl warranty :: this program is distributed in the hope that it will be useful but without any warranty
2 gpl verbatim_copies :: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
2 gpl your_freedom :: the licenses for most software are designed to take away your freedom to share and change it
2 gpl copyleft_license :: the gnu general public license is a free copyleft license for software and other kinds of works
2 lgpl free_software :: this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license( as published by the free software foundation)?
2 lgpl-2.1 free_software :: this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1( of the license)?( or at your option any later version)?
2 lgpl gnu :: you should have received a copy of the gnu (lesser|library) general public license along with this (program|software|library|file)
2 agpl gnu :: you should have received a copy of the gnu affero general public license along with this (program|software|library|file)
2 agpl-3 affero :: under the terms of the gnu affero general public license as published by the free software foundation either version 3( of the license)?( or at your option any later version)?
2 agpl remotely_through :: your modified version must prominently offer all users interacting with it remotely through a computer network
2 mpl-1.1 mozilla :: the contents of this file are subject to the mozilla public license version 1 1
2 mpl-2 mozilla :: this source code form is subject to the terms of the mozilla public license v 2 0
2 mpl-2 incompatible :: this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0
2 epl-1 eclipse_public :: this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
2 epl-2 eclipse_public :: this program and the accompanying materials are made available under the terms of the eclipse public license (v )?2 0
2 cddl-1.0 distribution_license :: the contents of this file are subject to the terms of the common development and distribution license
2 eupl-1.2 the_eupl :: licensed under the eupl( version)? (v )?1 2( or as soon they will be approved by the european commission)?
2 zlib this_software :: this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
2 zlib altered_source :: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
2 bsl-1.0 permission :: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
2 unlicense unencumbered :: this is free and unencumbered software released into the public domain
2 unlicense this_software :: anyone is free to copy modify publish use compile sell or distribute this software
2 wtfpl fuck :: do what the fuck you want to public license
2 cc0-1.0 waive :: to the extent possible under law [^ ]+( [^ ]+){0,10} (has|have) waived all copyright and related or neighboring rights
2 cc0-1.0 dedicat :: the person who associated a work with this deed has dedicated the work to the public domain
2 cc-by creative_commons :: this work is licensed under (the |a )?creative commons attribution( [1-4] [05])?( international| unported| generic)?( public)? license
2 cc-by-sa creative_commons :: this work is licensed under (the |a )?creative commons attribution share ?alike( [1-4] [05])?( international| unported| generic)?( public)? license
2 cc-by-nc creative_commons :: this work is licensed under (the |a )?creative commons attribution non ?commercial( [1-4] [05])?( international| unported| generic)?( public)? license
2 cc-by-nd creative_commons :: this work is licensed under (the |a )?creative commons attribution no ?deriv(ative)?s( [1-4] [05])?( international| unported| generic)?( public)? license
2 cc-by-nc-sa creative_commons :: this work is licensed under (the |a )?creative commons attribution non ?commercial share ?alike( [1-4] [05])?( international| unported| generic)?( public)? license
2 cc-by-nc-nd creative_commons :: this work is licensed under (the |a )?creative commons attribution non ?commercial no ?deriv(ative)?s( [1-4] [05])?( international| unported| generic)?( public)? license
2 ofl-1.1 font_software :: this font software is licensed under the sil open font license( version 1 1)?
2 artistic-2 standard_version :: you may distribute verbatim copies of the source form of the standard version of this package
2 python-2 psf_is :: psf is making python available to licensee on an as is basis
2 postgresql permission :: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
2 ncsa neither_the_names :: neither the names of [^ ]+( [^ ]+){0,12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
2 x11 except_as_contained :: except as contained in this notice the name of [^ ]+( [^ ]+){0,8} shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
2 curl permission :: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
2 openssl openssl :: this product includes software developed by the openssl project for use in the openssl toolkit
2 json good_not_evil :: the software shall be used for good not evil
2 busl-1.1 licensor_hereby :: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
2 sspl-1.0 as_a_service :: if you make the functionality of the program or a modified version available to third parties as a service
2 odbl-1.0 open_database :: this [^ ]+( [^ ]+){0,6} is made available under the open database license
2 odc-by-1.0 open_data :: this [^ ]+( [^ ]+){0,6} is made available under the open data commons attribution license
2 pddl-1.0 domain_dedication :: this [^ ]+( [^ ]+){0,6} is made available under the public domain dedication and license
2 gfdl free_documentation :: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license( version 1 [1-3])?( or any later version)?
2 upl-1.0 permission :: subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
2 proprietary rights_reserved :: all rights reserved( [^ ]+){0,12} (unauthorized|unauthorised) (copying|use|reproduction|distribution)
2 proprietary and_confidential :: proprietary and confidential
2 proprietary permission :: no part of this (publication|book|document|work) may be reproduced( [^ ]+){0,24} without( the)?( express)? prior( written)? permission
2 no-derivatives you_may_not :: you may not( [^ ]+){0,4} (reverse engineer|decompile|disassemble)( [^ ]+){0,3}
3 mit mit_licen :: ((released|licensed|distributed|available|published) )?under the mit license
3 mit mit_licen :: (released|licensed|distributed|available|published) under (the terms of )?(the )?mit licen[cs]e
3 mit expat :: (released|licensed|distributed|available|published) under (the )?expat licen[cs]e
3 apache-2 apache :: ((released|licensed|distributed|available|published) under (the )?)?apache license version 2( 0)?
3 apache-2 apache :: (released|licensed|distributed|available|published) under (the terms of )?(the )?apache( software)?( public)? (2( 0)? licen[cs]e|licen[cs]e (v2|v 2|2)( 0)?)
3 apache apache :: (released|licensed|distributed|available|published) under (the terms of )?(the )?apache( software)?( public)? licen[cs]e
3 bsd bsd :: (released|licensed|distributed|available|published) under (the terms of )?(the |a )?(modified |new |simplified |revised )?bsd( style)? licen[cs]e
3 bsd-2-clause bsd :: (released|licensed|distributed|available|published) under (the terms of )?(the |a )?(bsd (2|two) clause|(2|two) clause bsd|simplified bsd)( licen[cs]e)?
3 bsd-3-clause bsd :: (released|licensed|distributed|available|published) under (the terms of )?(the |a )?(bsd (3|three) clause|(3|three) clause bsd|new bsd|modified bsd)( licen[cs]e)?
3 isc isc_licen :: (released|licensed|distributed|available|published) under (the terms of )?(the )?isc licen[cs]e
3 zlib zlib :: (released|licensed|distributed|available|published) under (the terms of )?(the )?zlib( libpng)? licen[cs]e
3 gpl gnu :: (this work is )?(released|licensed|distributed|available|published) under (the terms of )?(the )?gnu( general public licen[cs]e| gpl)
3 gpl-2 gnu :: (this work is )?(released|licensed|distributed|available|published) under (the terms of )?(the )?gnu( general public licen[cs]e| gpl)( version| v)? ?2( 0)?( or( at your option)?( any)? later( version)?)?
3 gpl-3 gnu :: (this work is )?(released|licensed|distributed|available|published) under (the terms of )?(the )?gnu( general public licen[cs]e| gpl)( version| v)? ?3( 0)?( or( at your option)?( any)? later( version)?)?
3 gpl gpl :: (released|licensed|distributed|available|published) under (the terms of )?(the )?gpl( licen[cs]e)?
3 gpl-2 gpl :: (released|licensed|distributed|available|published) under (the terms of )?(the )?gpl( version| v)? ?2( 0)?( licen[cs]e)?
3 gpl-3 gpl :: (released|licensed|distributed|available|published) under (the terms of )?(the )?gpl( version| v)? ?3( 0)?( licen[cs]e)?
3 lgpl gnu :: (released|licensed|distributed|available|published) under (the terms of )?(the )?gnu (lesser|library) general public licen[cs]e
3 lgpl-2.1 gnu :: (released|licensed|distributed|available|published) under (the terms of )?(the )?gnu (lesser|library) general public licen[cs]e( version| v)? ?2 1( or( at your option)?( any)? later( version)?)?
3 lgpl-3 gnu :: (released|licensed|distributed|available|published) under (the terms of )?(the )?gnu (lesser|library) general public licen[cs]e( version| v)? ?3( 0)?( or( at your option)?( any)? later( version)?)?
3 lgpl lgpl :: (released|licensed|distributed|available|published) under (the terms of )?(the )?(gnu )?lgpl( ?(v|version) ?[23]( [01])?)?
3 agpl affero :: (released|licensed|distributed|available|published) under (the terms of )?(the )?(gnu )?affero general public licen[cs]e
3 agpl-3 affero :: (released|licensed|distributed|available|published) under (the terms of )?(the )?(gnu )?affero general public licen[cs]e( version| v)? ?3( 0)?( or( any)? later( version)?)?
3 agpl agpl :: (released|licensed|distributed|available|published) under (the terms of )?(the )?(gnu )?agpl( ?(v|version)? ?3( 0)?)?
3 mpl mozilla :: (released|licensed|distributed|available|published) under (the terms of )?(the )?mozilla public licen[cs]e
3 mpl-2 mozilla :: (released|licensed|distributed|available|published) under (the terms of )?(the )?mozilla public licen[cs]e( version| v)? ?2( 0)?
3 epl eclipse_public :: (released|licensed|distributed|available|published) under (the terms of )?(the )?eclipse public licen[cs]e
3 cddl distribution_licen :: (released|licensed|distributed|available|published) under (the terms of )?(the )?common development and distribution licen[cs]e
3 bsl-1.0 boost :: (released|licensed|distributed|available|published) under (the terms of )?(the )?boost software licen[cs]e( version 1 0)?
3 unlicense unlicense :: (released|licensed|distributed|available|published) under (the )?unlicense
3 wtfpl wtfpl :: (released|licensed|distributed|available|published) under (the )?wtfpl
3 public-domain public_domain :: (released|dedicated|placed) (in|into|to) the public domain
3 public-domain public_domain :: this (work|file|text|image|document|software) is in the public domain
3 cc0-1.0 cc0 :: (released|licensed|distributed|available|published) under (the )?cc0( 1 0)?( universal)?
3 cc-by cc_by :: ((this work is )?(released|licensed|distributed|available|published) under (a |the )?)?cc by [1-4] [05]
3 cc-by-sa cc_by :: ((this work is )?(released|licensed|distributed|available|published) under (a |the )?)?cc by sa( [1-4] [05])?
3 cc-by-nc cc_by :: ((this work is )?(released|licensed|distributed|available|published) under (a |the )?)?cc by nc( [1-4] [05])?
3 cc-by-nd cc_by :: ((this work is )?(released|licensed|distributed|available|published) under (a |the )?)?cc by nd( [1-4] [05])?
3 cc-by-nc-sa cc_by :: ((this work is )?(released|licensed|distributed|available|published) under (a |the )?)?cc by nc sa( [1-4] [05])?
3 cc-by-nc-nd cc_by :: ((this work is )?(released|licensed|distributed|available|published) under (a |the )?)?cc by nc nd( [1-4] [05])?
3 cc creative_commons :: (released|licensed|distributed|available|published) under (a |the )?creative commons( licen[cs]e)?
3 cc-by creative_commons :: (released|licensed|distributed|available|published) under (a |the )?creative commons attribution( [1-4] [05])?( international| unported| generic)?( licen[cs]e)?
3 cc-by-sa creative_commons :: (released|licensed|distributed|available|published) under (a |the )?creative commons attribution share ?alike( [1-4] [05])?( international| unported| generic)?( licen[cs]e)?
3 cc-by-nc creative_commons :: (released|licensed|distributed|available|published) under (a |the )?creative commons attribution non ?commercial( [1-4] [05])?( international| unported| generic)?( licen[cs]e)?
3 ofl-1.1 open_font :: (released|licensed|distributed|available|published) under (the )?(sil )?open font licen[cs]e( version)?( 1 1)?
3 artistic artistic_licen :: (released|licensed|distributed|available|published) under (the )?(perl )?artistic licen[cs]e
3 artistic-2 artistic_licen :: (released|licensed|distributed|available|published) under (the )?(perl )?artistic licen[cs]e( version)? 2( 0)?
3 gfdl free_documentation :: (released|licensed|distributed|available|published) under (the terms of )?(the )?gnu free documentation licen[cs]e( version 1 [1-3])?
3 odbl-1.0 open_database :: (released|licensed|distributed|available|published) under (the )?open database licen[cs]e
3 ogl-3.0 open_government :: (released|licensed|distributed|available|published|contains public sector information licensed) under (the )?open government licen[cs]e( v3 0| v 3 0| version 3 0)?
3 busl-1.1 business_source :: (released|licensed|distributed|available|published) under (the )?business source licen[cs]e( 1 1)?
3 sspl-1.0 server_side :: (released|licensed|distributed|available|published) under (the )?server side public licen[cs]e
3 elastic-2 elastic_licen :: (released|licensed|distributed|available|published) under (the )?elastic licen[cs]e( 2 0| v2)?
3 proprietary licen :: (released|licensed|distributed|available|published) under (a |an )?(proprietary|commercial|end user) licen[cs]e( agreement)?
4 mit mit_licen :: the mit licen[cs]e( mit)?
4 mit mit_licen :: mit licen[cs]e
4 apache-2 apache :: apache licen[cs]e (2|v2|v 2)( 0)?
4 apache apache :: apache (software |public )?licen[cs]e
4 bsd bsd :: bsd( style)? licen[cs]e
4 bsd-2-clause bsd :: (bsd (2|two) clause|(2|two) clause bsd|simplified bsd)( licen[cs]e)?
4 bsd-3-clause bsd :: (bsd (3|three) clause|(3|three) clause bsd|new bsd|modified bsd)( licen[cs]e)?
4 isc isc_licen :: isc licen[cs]e
4 zlib zlib :: zlib( libpng)? licen[cs]e
4 gpl gnu :: gnu general public licen[cs]e
4 gpl-2 gnu :: gnu general public licen[cs]e( version| v)? ?2( 0)?( or( at your option)?( any)? later( version)?)?
4 gpl-3 gnu :: gnu general public licen[cs]e( version| v)? ?3( 0)?( or( at your option)?( any)? later( version)?)?
4 lgpl gnu :: gnu (lesser|library) general public licen[cs]e
4 lgpl-2.1 gnu :: gnu (lesser|library) general public licen[cs]e( version| v)? ?2 1( or( at your option)?( any)? later( version)?)?
4 lgpl-3 gnu :: gnu (lesser|library) general public licen[cs]e( version| v)? ?3( 0)?( or( at your option)?( any)? later( version)?)?
4 agpl affero :: (gnu )?affero general public licen[cs]e
4 agpl-3 affero :: (gnu )?affero general public licen[cs]e( version| v)? ?3( 0)?
4 gfdl free_documentation :: gnu free documentation licen[cs]e
4 mpl mozilla :: mozilla public licen[cs]e
4 mpl-1.1 mozilla :: mozilla public licen[cs]e( version| v)? ?1 1
4 mpl-2 mozilla :: mozilla public licen[cs]e( version| v)? ?2( 0)?
4 epl eclipse_public :: eclipse public licen[cs]e
4 eupl european_union :: european union public licen[cs]e
4 cddl distribution_licen :: common development and distribution licen[cs]e
4 cpl-1.0 common_public :: common public licen[cs]e( version)?( 1 0)?
4 bsl-1.0 boost :: boost software licen[cs]e
4 ncsa university_of_illinois :: university of illinois ncsa open source licen[cs]e
4 python-2 python_software :: python software foundation licen[cs]e
4 postgresql postgresql_licen :: postgresql licen[cs]e
4 artistic artistic_licen :: artistic licen[cs]e
4 ofl-1.1 open_font :: sil open font licen[cs]e
4 cc0-1.0 cc0 :: cc0 1 0( universal)?
4 cc-by creative_commons :: creative commons attribution( [1-4] [05])?
4 cc-by-sa creative_commons :: creative commons attribution share ?alike( [1-4] [05])?
4 cc-by-nc creative_commons :: creative commons attribution non ?commercial( [1-4] [05])?
4 cc-by-nd creative_commons :: creative commons attribution no ?deriv(ative)?s( [1-4] [05])?
4 cc-by-nc-sa creative_commons :: creative commons attribution non ?commercial share ?alike( [1-4] [05])?
4 cc-by-nc-nd creative_commons :: creative commons attribution non ?commercial no ?deriv(ative)?s( [1-4] [05])?
4 odbl-1.0 open_database :: open database licen[cs]e
4 odc-by-1.0 data_commons :: open data commons attribution licen[cs]e
4 pddl-1.0 domain_dedication :: public domain dedication and licen[cs]e
4 ogl-3.0 open_government :: open government licen[cs]e
4 cdla-permissive community_data :: community data license agreement permissive( version)?( [12] 0)?
4 cdla-sharing community_data :: community data license agreement sharing( version)?( 1 0)?
4 ms-pl microsoft_ :: microsoft public licen[cs]e
4 ms-rl microsoft_ :: microsoft reciprocal licen[cs]e
4 osl-3.0 open_software :: open software licen[cs]e( version)?( 3 0)?
4 afl-3.0 academic_free :: academic free licen[cs]e( version)?( 3 0)?
4 ecl-2.0 educational_community :: educational community licen[cs]e( version)?( 2 0)?
4 upl-1.0 universal_permissive :: universal permissive licen[cs]e
4 mulan-psl-2 mulan :: mulan permissive software licen[cs]e( version)?( 2)?
4 busl-1.1 business_source :: business source licen[cs]e
4 sspl-1.0 server_side :: server side public licen[cs]e
4 elastic-2 elastic_licen :: elastic licen[cs]e( 2 0| v2)
4 polyform polyform :: polyform (noncommercial|small business|internal use|strict|shield|perimeter) licen[cs]e
4 openrail open_rail :: (creativeml )?open rail( [mds])? licen[cs]e
5 apache-2 apache :: (https? )?(www )?apache org licenses license 2 0( txt| html)?
5 mit opensource :: (https? )?(www )?opensource org licenses? mit( license)?( php)?
5 apache-2 opensource :: (https? )?(www )?opensource org licenses? apache 2 0
5 bsd-2-clause opensource :: (https? )?(www )?opensource org licenses? bsd 2 clause
5 bsd-3-clause opensource :: (https? )?(www )?opensource org licenses? bsd 3 clause
5 gpl gnu :: (https? )?(www )?gnu org (copyleft|licenses) gpl( html| txt)?
5 gpl-2 gnu :: (https? )?(www )?gnu org licenses (old licenses )?gpl 2 0( html| txt)?
5 gpl-3 gnu :: (https? )?(www )?gnu org licenses gpl 3 0( html| txt)?
5 lgpl gnu :: (https? )?(www )?gnu org (copyleft|licenses) (old licenses )?lgpl( [23] [01])?( html| txt)?
5 agpl gnu :: (https? )?(www )?gnu org licenses agpl( 3 0)?( html| txt)?
5 mpl-2 mozilla :: (https? )?(www )?mozilla org (en us )?mpl 2 0
5 epl eclipse_org :: (https? )?(www )?eclipse org (legal|org documents) epl (v10|2 0|v20)( html| txt)?
5 cc0-1.0 creativecommons :: (https? )?(www )?creativecommons org publicdomain zero 1 0
5 cc-by creativecommons :: (https? )?(www )?creativecommons org licenses by [1-4] [05]
5 cc-by-sa creativecommons :: (https? )?(www )?creativecommons org licenses by sa [1-4] [05]
5 cc-by-nc creativecommons :: (https? )?(www )?creativecommons org licenses by nc [1-4] [05]
5 cc-by-nd creativecommons :: (https? )?(www )?creativecommons org licenses by nd [1-4] [05]
5 cc-by-nc-sa creativecommons :: (https? )?(www )?creativecommons org licenses by nc sa [1-4] [05]
5 cc-by-nc-nd creativecommons :: (https? )?(www )?creativecommons org licenses by nc nd [1-4] [05]
5 unlicense unlicense :: (https? )?unlicense org
5 wtfpl wtfpl :: (https? )?(www )?wtfpl net
5 ofl-1.1 scripts_sil :: (https? )?scripts sil org ofl
5 gpl-2 gpl :: gpl ?(v|version) ?2( 0)?( only| or later)?
5 gpl-3 gpl :: gpl ?(v|version) ?3( 0)?( only| or later)?
5 gpl-2 gplv2 :: gplv2( 0)?
5 gpl-3 gplv3 :: gplv3( 0)?
5 lgpl-2.1 lgplv2 :: lgplv2 1
5 lgpl-3 lgplv3 :: lgplv3
5 agpl-3 agplv3 :: agplv3
"""

#: (tier, label, keyword, pattern), in order of precedence.
RULES = [(int(head.split()[0]), head.split()[1], head.split()[2], pattern) for head, pattern in (line.split(" :: ") for line in _TEXT.strip().splitlines())]

# The phrases that every scan must find, and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# End of fixed values.

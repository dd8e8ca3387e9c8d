"""Inputs after the examples and grammars of the CSS specifications, and what must come out."""

#: (property, value, default spelling, aggressive spelling)
VALUES = [
    ('background-color', 'RebeccaPurple', '#663399', '#663399'),
    ('color', '#AbC', '#aabbcc', '#aabbcc'),
    ('outline-color', 'rgb(12 200 7)', '#0cc807', '#0cc807'),
    ('color', 'rgba(10,20,30,.0)', 'rgba(10,20,30,0)', 'rgba(10,20,30,0)'),
    ('fill', 'rgb(0%, 50%, 100%)', 'rgb(0,50%,100%)', '#0080ff'),
    ('color', 'HSL(240deg 100% 25%)', 'hsl(240deg 100% 25%)', '#000080'),
    ('stroke', '#0F0F0FFF', '#0f0f0f', '#0f0f0f'),
    ('color', 'hsla(60,100%,50%,50%)', 'hsla(60,100%,50%,50%)', 'rgba(255,255,0,.5)'),
    ('column-rule-color', 'hwb(90 10% 10%)', 'hwb(90 10% 10%)', 'hwb(90 10% 10%)'),
    ('inset', '4px 8px 4px 8px', '4px 8px', '4px 8px'),
    ('scroll-margin', '2em 2em', '2em', '2em'),
    ('border-radius', '3px 3px / 5px 5px', '3px/5px', '3px/5px'),
    ('row-gap', '07px', '07px', '07px'),
    ('flex-grow', '2.500', '2.5', '2.5'),
    ('z-index', '+3', '3', '3'),
    ('letter-spacing', '-0.250em', '-.25em', '-.25em'),
    ('tab-size', '4.0', '4', '4'),
    ('top', '0.0%', '0', '0'),
    ('transition-delay', '1.25S', '1250ms', '1250ms'),
    ('animation-duration', '0.0005s', '.5ms', '.5ms'),
    ('animation-delay', '30ms', '30ms', '30ms'),
    ('rotate', '200grad', '200grad', '180deg'),
    ('rotate', '.5turn', '.5turn', '180deg'),
    ('offset-rotate', 'auto 0rad', 'auto 0rad', 'auto 0deg'),
    ('width', 'max(9px , 10px, 1px)', 'max(10px,1px,9px)', 'max(10px,1px,9px)'),
    ('width', 'clamp(1px, 2px, 3px)', 'clamp(1px,2px,3px)', 'clamp(1px,2px,3px)'),
    ('inline-size', 'min( 4em , max(2px, 1px) )', 'min(4em,max(1px,2px))', 'min(4em,max(1px,2px))'),
    ('height', 'calc( 100% - ( 2 * 3px ) )', 'calc(100% - (2 * 3px))', 'calc(100% - (2 * 3px))'),
    ('font', 'italic  BOLD 1.20em / 1.0 Georgia , serif', 'italic bold 1.2em/1 georgia,serif', 'italic bold 1.2em/1 georgia,serif'),
    ('font-weight', 'Normal', '400', '400'),
    ('border-left', '0', 'none', 'none'),
    ('outline', 'none', 'none', 'none'),
    ('grid-area', 'Header', 'Header', 'Header'),
    ('counter-reset', 'Item 2', 'Item 2', 'Item 2'),
    ('quotes', "'« '  ' »'", "'« ' ' »'", "'« ' ' »'"),
    ('--Gap', ' 2PX  3px ', '2PX  3px', '2PX  3px'),
    ('margin', 'var(  --Gap  ,  1px )', 'var(--Gap,1px)', 'var(--Gap,1px)'),
    ('background', 'URL( Img.PNG ) no-repeat', 'URL( Img.PNG ) no-repeat', 'URL( Img.PNG ) no-repeat'),
    ('background-image', "url('a  b.png')", "url('a  b.png')", "url('a  b.png')"),
]
#: (selector list, its selectors)
LISTS = [
    ('h1,h2 , h3', ['h1', 'h2', 'h3']),
    ('ul > li:not(.x, .y),ol', ['ul > li:not(.x, .y)', 'ol']),
    ("a[title='1, 2'], b", ["a[title='1, 2']", 'b']),
    ('p/* one, two */ ,q', ['p/* one, two */', 'q']),
    ('\\31 2\\,3 , s', ['\\31 2\\,3', 's']),
    (':where(a, b', [':where(a, b']),
    ('x,,y,', ['x', '', 'y']),
]
#: (selector, selector, exclusive, likely disjoint)
PAIRS = [
    ('body[dir=ltr] p', 'body[dir=rtl] p', False, False),
    (":root[data-theme='dark'] .k p", ":root[data-theme='light'] .k p", True, False),
    ('form[method=get] > input', 'form[method=post] > input', True, False),
    ("tr[data-n='1'] + tr", "tr[data-n='2'] + tr", True, False),
    ("tr[data-n='1'] ~ tr", "tr[data-n='2'] ~ tr", False, False),
    ('nav[role=a] li', 'nav[role=b] li', False, False),
    ('input[type=text]', "input[type='TEXT']", False, False),
    ('[lang|=en]', '[lang|=de]', False, False),
    ("a[href$='.pdf' i]", "a[href$='.doc' i]", False, False),
    ("[x='\\42 ']", '[x=B]', False, False),
    (":is([k='1'])", ":is([k='2'])", False, False),
    ("a[k='1'][m='2']", "a[k='1'][m='3']", True, False),
    ("a[k='1']", "b[k='2']", False, True),
    ('[k]', "[k='1']", False, False),
    ('table.t', 'tbody.t', False, True),
    ('#top', '#end', False, True),
    ('.one.two', '.three', False, True),
    ('.one.two', '.two', False, False),
    ('li:first-child', 'li:last-child', False, False),
    ('svg|a', 'b', False, False),
    ('main *', 'main .x', False, False),
    ('.x:not(.y)', '.z', False, False),
]
#: (sheet, aggressive, consolidated sheet, how many applied, how many skipped)
SHEETS = [
    ('h1 { top: 3px }\nh2 { top: 3PX }\n', False, 'h1, h2 { top: 3px }\n', 1, 0),
    ('#x{left:0px}#y{left:0em}#z{left:0}', False, '#x,#y,#z{left:0}', 1, 0),
    ('i { width: 1px; }\nb { width: 2px; }\nu { width: 1px; }\n', False, 'i { width: 1px; }\nb { width: 2px; }\nu { width: 1px; }\n', 0, 1),
    ('i { width: 1px; }\nb { min-width: 2px; }\nu { width: 1px; }\n', False, 'b { min-width: 2px; }\ni, u { width: 1px; }\n', 1, 0),
    ('p { flex: 1; flex: 1; order: 2; }\n', False, 'p { flex: 1; order: 2; }\n', 1, 0),
    ('dt { padding: 1px; padding-top: 2px; }\ndd { padding: 1px; }\n', False, 'dt, dd { padding: 1px; }\ndt { padding-top: 2px; }\n', 1, 0),
    ('dt { gap: 1px; row-gap: 2px; }\ndd { row-gap: 2px; }\n', False, 'dt { gap: 1px; }\ndt, dd { row-gap: 2px; }\n', 1, 0),
    ('th { order: 1; float: left; }\ntd { order: 1; float: left; }\n', False, 'th, td { order: 1; float: left; }\n', 2, 0),
    ('q { order: 1; }\ns { float: left; }\nu { order: 1; float: left; }\n', False, 'q, u { order: 1; }\ns, u { float: left; }\n', 2, 0),
    ('em { order: 1; }\nem { float: left; }\n', False, 'em { order: 1; float: left; }\n', 1, 0),
    ('@supports (a: b) { i { rotate: 180deg; } }\n@supports (a: b) { b { rotate: .5turn; } }\n', True, '@supports (a: b) { i, b { rotate: 180deg; } }\n', 1, 0),
    ('@media print { i { top: 0; } b { top: 0; } }\n', False, '@media print { i, b { top: 0; } }\n', 1, 0),
    ('input[type=a] { width: 1px; }\ninput[type=b] { width: 2px; }\ninput[type=a] > u { width: 1px; }\n', False, 'input[type=a] { width: 1px; }\ninput[type=b] { width: 2px; }\ninput[type=a] > u { width: 1px; }\n', 0, 1),
    ("a[k='1'] { width: 1px; }\na[k='2'] { width: 2px; }\na[k='1'] { height: 1px; width: 1px; }\n", False, "a[k='2'] { width: 2px; }\na[k='1'] { height: 1px; width: 1px; }\n", 2, 0),
]

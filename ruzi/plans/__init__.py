"""From statement text to a bound plan: lexer, syntax tree, parser and binder."""

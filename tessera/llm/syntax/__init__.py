"""Source files that do not parse: bundled grammars, a chart over bracket groups, and the operator."""

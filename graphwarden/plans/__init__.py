"""From shapes to rules: syntax tree, mapping to labels and columns, lowering, manifest."""

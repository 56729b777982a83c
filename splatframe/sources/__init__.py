"""Tables as the operators take them: read, validated, or derived."""

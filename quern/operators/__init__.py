"""DataFrame operators; each module states its inputs, outputs and defined results for edge cases."""

"""Part of loomwright."""

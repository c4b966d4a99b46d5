"""Program analysis of single functions: control flow, dependences, slices."""

"""Where results go: bundles, manifests, packages, reports, previews."""

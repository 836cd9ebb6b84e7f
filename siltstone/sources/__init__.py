"""siltstone sources"""

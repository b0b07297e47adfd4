"""orderkeep.sources"""
